"""Byte-level BPE through one global shuffle of distinct pre-tokens; decoding joins the table of token bytes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm.common import saved
from glossmark.llm.rolling import pieces

#: A block of texts ends with so many bytes or distinct pre-tokens. Parts to which distinct pre-tokens are dealt.
BLOCK_BYTES, BLOCK_WORDS, PARTS = 1 << 24, 1 << 19, 1 << 12
#: Order of a block's rows where it is put together.
_PIECES, _ANSWERS, _TEXTS = 0, 1, 2


def ranks_of(definition: str) -> dict[bytes, int]:
    """Token bytes and ids, from lines of a base64 token and its id."""
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in definition.splitlines() if line)}


def token_bytes(spark: SparkSession, definition: str) -> DataFrame:
    """(id, piece): the bytes of each id. The vocabulary bounds it."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks_of(definition).items()], "id int, piece binary")


def _encoder(definition: str):
    """Encodes one pre-token as it stands, uncut."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(definition), special_tokens={}).encode_ordinary


class _Block:
    """Texts in turn, as codes of their pre-tokens: places among the block's distinct ones."""
    def __init__(self):
        self.places: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.rows: list[tuple[pa.RecordBatch, int]] = []
        self.bytes = 0

    def add(self, words: list[str], row, size: int) -> None:
        places = self.places
        self.codes.append(np.array([places.setdefault(w, len(places)) for w in words], np.int32))
        self.rows.append(row)
        self.bytes += size

    def full(self, most: int) -> bool:
        return self.bytes >= most or len(self.places) >= BLOCK_WORDS

    def words(self) -> tuple[int, list[bytes]]:
        """The block's name, a digest of its distinct pre-tokens in order, and these."""
        words = [w.encode() for w in self.places]
        name = xxhash.xxh3_64()
        for w in words:
            name.update(len(w).to_bytes(4, "little") + w)
        return name.intdigest() - (1 << 63), words


def _blocks(batches, pattern: str, most: int):
    import regex

    cut, block = regex.compile(pattern).findall, _Block()
    for batch in pieces(batches):
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, (text, size) in enumerate(zip(batch.column("text").to_pylist(), sizes, strict=True)):
            block.add(cut(text or ""), (batch, i), size)
            if block.full(most):
                yield block
                block = _Block()
    if block.rows:
        yield block


def _asked(pattern: str, most: int):
    """Batches of texts to rows (block, part, places, words): the block's distinct pre-tokens, dealt by their digest."""
    def run(batches):
        for block in _blocks(batches, pattern, most):
            name, words = block.words()
            if not words:
                continue
            parts = np.array([xxhash.xxh3_64_intdigest(w) % PARTS for w in words])
            order = np.argsort(parts, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(parts[order], prepend=-1)), len(order)).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(edges), pa.array([words[i] for i in order.tolist()], pa.binary()))
            places = pa.ListArray.from_arrays(pa.array(edges), pa.array(order.astype(np.int32)))
            whole = pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(edges) - 1), pa.int64()), pa.array(parts[order][edges[:-1]].astype(np.int32)), places, column],
                names=["block", "part", "places", "words"])
            yield from pieces([whole], 256)

    return run


def _encoded(definition: str):
    """Rows of parts, each part's together, to (block, places, sizes, ids). A pre-token stands in one part and is
    encoded when the part first shows it."""
    def run(batches):
        encode, part, known = _encoder(definition), None, {}
        for batch in pieces(batches, 64):
            ids, sizes = [], []
            for now, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if now != part:
                    part, known = now, {}
                for w in words:
                    if w not in known:
                        known[w] = encode(w.decode())
                found = [known[w] for w in words]
                sizes.append(list(map(len, found)))
                ids.append([i for x in found for i in x])
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("places"), pa.array(sizes, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))],
                names=["block", "places", "sizes", "ids"])

    return run


def _coded(pattern: str, most: int):
    """Batches of texts to rows (block, head, codes, n) of the same blocks as ``_asked`` makes."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for block in _blocks(batches, pattern, most):
            name, _ = block.words()
            codes = [press.compress(c.tobytes()) for c in block.codes]
            at = 0
            while at < len(block.rows):
                batch, first = block.rows[at]
                n = 1
                while at + n < len(block.rows) and block.rows[at + n][0] is batch:
                    n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.int64()), pa.array([len(block.places)] * n, pa.int32()), batch.column("head").slice(first, n),
                     pa.array(codes[at: at + n], pa.binary())], names=["block", "distinct", "head", "codes"])
                at += n

    return run


class _Answers:
    """What is known of one block: the ids of its pre-tokens by place, and the bytes of its ids."""
    def __init__(self):
        self.piece: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = None

    def table(self, distinct: int):
        """(first, size, ids): where each place's ids stand."""
        if self.ready is None:
            places, sizes, ids = (np.concatenate(x) if x else np.empty(0, np.int32) for x in zip(*self.parts)) if self.parts else [np.empty(0, np.int32)] * 3
            size, first = np.full(distinct, -1, np.int64), np.zeros(distinct, np.int64)
            size[places], first[places] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
            if (size < 0).any():
                raise ValueError("texts came in another order when they were read again: write the input as a table first")
            self.ready = first, size, ids
        return self.ready

    def put_together(self, codes: np.ndarray, distinct: int) -> tuple[np.ndarray, bytes]:
        """The ids of a coded text and the bytes that they decode to."""
        first, size, ids = self.table(distinct)
        sizes = size[codes]
        ends = np.cumsum(sizes)
        found = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - sizes), sizes)]
        return found, b"".join([self.piece[i] for i in found.tolist()])


def _assembled(output: str, names, kinds):
    def run(batches):
        press, block, known = zstandard.ZstdDecompressor(), None, _Answers()
        for batch in pieces(batches, 512):
            made, at = [], []
            columns = (batch.column(c).to_pylist() for c in ("block", "kind", "id", "piece", "distinct", "codes"))
            lists = [batch.column(c) for c in ("places", "sizes", "ids")]
            for i, (now, kind, one, piece, distinct, codes) in enumerate(zip(*columns, strict=True)):
                if now != block:
                    block, known = now, _Answers()
                if kind == _PIECES:
                    known.piece[one] = piece
                elif kind == _ANSWERS:
                    known.parts.append(tuple(x[i].values.to_numpy() for x in lists))
                else:
                    ids, text = known.put_together(np.frombuffer(press.decompress(codes), np.int32), distinct)
                    at.append(i)
                    made.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()) if output == "digest" else (ids, text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("head").take(pa.array(at, pa.int64())), *[pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]],
                names=["head", *names])

    return run


def encode(
    docs: DataFrame, definition: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), output: str = "digest",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Encodes and decodes each row's whole text; each match of ``pattern`` is encoded apart, without special tokens.

    ``definition`` has one base64 token and its id a line. ``output`` digest: (key, *keep, n_tokens, ids_sha256,
    decoded_sha256), digests of the ids as little-endian 32-bit integers and of the decoded bytes; ids: (key, *keep, ids,
    decoded).

    Texts are taken in blocks of bounded size; a block's distinct pre-tokens go out once, with their places, to the part
    of the vocabulary that their digest names, so that a word in every text is one entry a block. A part encodes each of
    its words once; ids go back to their block and stand where the words stood. For decoding, the block's distinct
    ids join the table of token bytes, whose size the vocabulary bounds.

    Texts are cut twice, once for their words and once for their codes, and a block bears the digest of its words; an
    input that gives its rows in another order the second time (a shuffle, not files) is refused and has to be written
    first. Null and empty texts have no ids; repeated rows, keys and nulls stay as they are; an empty table gives none.
    """
    read = docs.select(F.col(text).alias("text"), F.struct(key, *keep).alias("head"))
    asked = read.mapInArrow(_asked(pattern, block_bytes), "block long, part int, places array<int>, words array<binary>")
    dealt = asked.repartition("part").sortWithinPartitions("part")
    answers = saved(dealt.mapInArrow(_encoded(definition), "block long, places array<int>, sizes array<int>, ids array<int>"))
    told = answers.select("block", F.explode(F.array_distinct("ids")).alias("id")).distinct()
    told = told.join(F.broadcast(token_bytes(docs.sparkSession, definition)), "id").select("block", "id", "piece")
    head = f"head {read.schema['head'].dataType.simpleString()}"
    texts = read.mapInArrow(_coded(pattern, block_bytes), f"block long, distinct int, {head}, codes binary")
    rows = texts.withColumn("kind", F.lit(_TEXTS))
    rows = rows.unionByName(answers.withColumn("kind", F.lit(_ANSWERS)), allowMissingColumns=True)
    rows = rows.unionByName(told.withColumn("kind", F.lit(_PIECES)), allowMissingColumns=True)
    names = ("n_tokens", "ids_sha256", "decoded_sha256") if output == "digest" else ("ids", "decoded")
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if output == "digest" else "ids array<int>, decoded binary"
    kinds = (pa.int64(), pa.string(), pa.string()) if output == "digest" else (pa.list_(pa.int32()), pa.binary())
    met = rows.repartition("block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_assembled(output, names, kinds), f"{head}, {made}").select("head.*", *names)
