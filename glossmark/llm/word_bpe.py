"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmark.llm.common import frequency_floor, saved
from glossmark.llm.rolling import pieces, split_words, word_counts

#: Frequent words whose codes every task holds: at most so many, of so many bytes. The others are joined.
HELD_WORDS, HELD_BYTES = 1 << 19, 48
#: Documents, about, whose words say which are frequent. Any choice gives the same result.
SAMPLED = 30_000
#: The place of a document behind all its words' answers.
LAST = 2**31 - 1
#: Codes whose bits are laid out at once, and the places of a code's bits.
_AT_ONCE, _BIT = 1 << 15, np.arange(31, dtype=np.int32)


def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pieces(definition: str) -> list[str]:
    tokenizer = _tokenizer(definition)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    return pieces


def _width(names: list[str]) -> str:
    """The array type of packed ids: two bytes each where the vocabulary fits, else four."""
    return "H" if len(names) <= 1 << 16 else "i"


def squeezed(codes: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Codes from 0 on, small ones in fewer bits: pressed bit lengths, then the bits below each leading one."""
    value = codes.astype(np.int32) + 1
    sizes = (np.frexp(value.astype(np.float64))[1] - 1).astype(np.uint8)
    head, bits = press.compress(sizes.tobytes()), []
    for at in range(0, len(value), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        spread = (value[some, None] >> _BIT).astype(np.uint8) & 1
        bits.append(spread[_BIT < sizes[some, None]])
    return len(head).to_bytes(4, "little") + head + np.packbits(np.concatenate(bits) if bits else np.empty(0, np.uint8)).tobytes()


def expanded(raw: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    """The codes that ``squeezed`` packed."""
    body = 4 + int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(press.decompress(raw[4:body]), np.uint8).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(raw[body:], np.uint8)) if body < len(raw) else np.empty(0, np.uint8)
    out, read = (np.int32(1) << sizes) - 1, 0
    for at in range(0, len(sizes), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        held = _BIT < sizes[some, None]
        spread = np.zeros(held.shape, np.int32)
        end = int(ends[some][-1])
        spread[held] = bits[read:end]
        out[some] += (spread << _BIT).sum(axis=1, dtype=np.int32)
        read = end
    return out.astype(np.int64)


def encode_words(words: DataFrame, definition: str, width: str) -> DataFrame:
    """(word, ids) with all columns of ``words``, which has equal words next to each other in a partition.

    Each run of a word is encoded once; ids are packed as integers of array type ``width``. White space never gives a piece or
    joins what stands on its two sides, so a text's ids are its words' ids in order, special tokens
    inside words included.
    """
    def run(batches):
        tokenizer, last, last_ids = _tokenizer(definition), None, b""
        for batch in pieces(batches, 8192):
            column = batch.column("word").dictionary_encode()
            words = column.dictionary.to_pylist()
            fresh = [w for w in words if w != last]
            made = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in fresh], add_special_tokens=False)
            table = {w: array(width, e.ids).tobytes() for w, e in zip(fresh, made, strict=True)} | ({last: last_ids} if last is not None else {})
            ids = pa.array([table[w] for w in words], pa.binary()).take(column.indices)
            last = words[column.indices[-1].as_py()]
            last_ids = table[last]
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("ids", T.BinaryType())]))


class _Held:
    """The frequent words of one run in a worker: ranks, ids and pieces as text, made once a process."""
    now: tuple[int, _Held] | None = None

    def __init__(self, raw: bytes, names: list[str]):
        table = pa.ipc.open_stream(raw).read_all()
        self.rank = {w: i for i, w in enumerate(table["word"].to_pylist())}
        ids = [array(_width(names), x) for x in table["ids"].to_pylist()]
        self.names = names
        self.counts = np.array([len(x) for x in ids] or [0])
        self.as_ids = np.array([*map(_decimals, ids), b""], object)
        self.as_text = np.array([*(_joined(names, x) for x in ids), b""], object)

    @classmethod
    def of(cls, shared) -> _Held:
        if cls.now is None or cls.now[0] != shared.value[0]:
            cls.now = shared.value[0], cls(*shared.value[1:])
        return cls.now[1]

    def coded(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word, in order: the held word's rank, or their number plus the place in the list of others."""
        words = split_words(text)
        codes = np.fromiter(map(self.rank.get, words, itertools.repeat(-1)), np.int64, len(words))
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(codes < 0).tolist():
            codes[i] = len(self.rank) + others.setdefault(words[i], len(others))
        return codes, list(others)

    def assembled(self, codes: np.ndarray, found: dict[int, bytes]) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as decimals and the decoded text of a coded document."""
        top = len(self.rank)
        held = np.minimum(codes, top)
        counts, ids, text = self.counts[np.minimum(held, max(top - 1, 0))], self.as_ids[held], self.as_text[held]
        rare = np.flatnonzero(codes >= top)
        if len(rare):
            places = (codes[rare] - top).tolist()
            arrays = {p: array(_width(self.names), found[p]) for p in set(places)}
            decimals, pieces_of = ({p: f(x) for p, x in arrays.items()} for f in (_decimals, lambda x: _joined(self.names, x)))
            counts[rare] = [len(arrays[p]) for p in places]
            ids[rare], text[rare] = [decimals[p] for p in places], [pieces_of[p] for p in places]
        if len(counts) and not counts.all():
            ids, text = ids[counts > 0], text[counts > 0]
        return int(counts.sum()), b" ".join(ids.tolist()), b" ".join(text.tolist())


def _decimals(ids) -> bytes:
    return " ".join(map(str, ids)).encode()


def _joined(names: list[str], ids) -> bytes:
    return " ".join([names[i] for i in ids]).encode()


def _frequent(read: DataFrame, definition: str, width: str) -> bytes:
    """The most frequent words of a sample of the texts with their ids, as an Arrow stream."""
    share = min(1.0, SAMPLED / max(read.count(), 1))
    sampled = read.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = saved(word_counts(sampled.select("text")).where(F.octet_length("word") <= HELD_BYTES))
    floor = frequency_floor(counts, "n", HELD_WORDS)
    rows = encode_words(counts.where(F.col("n") >= floor), definition, width).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.binary()), ("ids", pa.binary())])) as stream:
        stream.write_table(rows.select(["word", "ids"]).cast(pa.schema([("word", pa.binary()), ("ids", pa.binary())])))
    return sink.getvalue().to_pybytes()


def encode(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), output: str = "digest") -> DataFrame:
    """Encodes and decodes each row's whole text.

    ``definition`` is the tokenizer's JSON. ``output`` digest: (key, *keep, n_tokens, ids_sha256, decoded_sha256), the
    digests of the ids as decimals joined by one space and of the decoded text; ids: (key, *keep, ids, decoded).

    The most frequent words, bounded in number and bytes, are encoded once and go to every task. All other words are
    dealt by word, one row for each document that holds it, and each distinct one is encoded once where its
    rows meet; the ids go back by document and place. Documents travel to that join as
    word codes of varied length. Decoding looks every id up in the table of pieces, whose size the vocabulary bounds.
    Null and empty texts have no ids; repeated rows, keys and nulls are kept as they are; an empty table gives none.
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.col(key).cast("string"), F.coalesce(text, F.lit("")))
    read = docs.select(F.col(text).alias("text"), row.alias("row"), F.struct(key, *keep).alias("head"))
    names = _pieces(definition)
    width = _width(names)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, _frequent(read, definition, width), names))

    def others_of(batches):
        for batch in pieces(batches):
            row, place, word = [], [], []
            for r, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                others = _Held.of(shared).coded(t)[1]
                row += [r] * len(others)
                place += range(len(others))
                word += others
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(word, pa.binary())], names=["row", "place", "word"])

    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            codes = [squeezed(_Held.of(shared).coded(t)[0], squeeze) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([LAST] * batch.num_rows, pa.int32()), pa.array(codes, pa.binary()),
                 batch.column("head")], names=["row", "place", "data", "head"])

    def assembled(batches):
        expand, current, found = zstandard.ZstdDecompressor(), None, {}
        for batch in pieces(batches, 2048):
            out, at = [], []
            columns = (batch.column(c).to_pylist() for c in ("row", "place", "data"))
            for i, (row, place, data) in enumerate(zip(*columns, strict=True)):
                if row != current:
                    current, found = row, {}
                if place != LAST:
                    found[place] = data
                    continue
                n, ids, decoded = _Held.of(shared).assembled(expanded(data, expand), found)
                at.append(i)
                if output == "digest":
                    out.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    out.append((list(map(int, ids.split())), decoded.decode()))
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([batch.column("head").take(pa.array(at, pa.int64())), *made], names=["head", *results])

    results = ("n_tokens", "ids_sha256", "decoded_sha256") if output == "digest" else ("ids", "decoded")
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if output == "digest" else "ids array<int>, decoded string"
    arrow = (pa.int64(), pa.string(), pa.string()) if output == "digest" else (pa.list_(pa.int32()), pa.string())
    head = f"head {docs.select(F.struct(key, *keep).alias('h')).schema['h'].dataType.simpleString()}"
    asked = read.select("text", "row").mapInArrow(others_of, "row long, place int, word binary")
    answers = encode_words(asked.repartition("word").sortWithinPartitions("word"), definition, width).select("row", "place", F.col("ids").alias("data"))
    texts = read.mapInArrow(packed, f"row long, place int, data binary, {head}")
    met = texts.unionByName(answers, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "place")
    return met.mapInArrow(assembled, f"{head}, {kinds}").select("head.*", *results)
