"""Cross-tokenizer alignment: byte ranges of a text as fragments that compose in any grouping, and link counts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import arrow_rows, frequency_floor, saved
from glossmark.llm.rolling import pieces

#: Bytes of a text that make one fragment, and fragments that one task composes at a time.
CHUNK_BYTES, FAN_IN = 1 << 16, 8
#: Texts in one Arrow batch, and fragments or whole rows of ids.
TEXT_ROWS, LONG_ROWS = 256, 16
#: The commonest linked id pairs, at most, whose counts every task holds (17 bytes each). All others are joined.
HELD_PAIRS = 1 << 20

_PART = "struct<cut:boolean,head_a:array<int>,head_b:array<int>,a:array<int>,b:array<int>,n_a:array<int>,n_b:array<int>,tail_a:array<int>,tail_b:array<int>>"
_INTS = pa.list_(pa.int32())


@dataclass
class Fragment:
    """A byte range's tokens of both kinds, cut where both end.

    Before the first cut is the open head, after the last the open tail; between stand whole groups, ``n_a`` and ``n_b``
    tokens each. Without a cut all tokens are head. Tokens belong to the range in which they end.
    """
    cut: bool
    head_a: np.ndarray
    head_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    tail_a: np.ndarray
    tail_b: np.ndarray

    @classmethod
    def of(cls, a, b, ends_a, ends_b) -> Fragment:
        """From the tokens of a range and the byte offsets where they end."""
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        none = a[:0]
        if not len(cuts):
            return cls(False, a, b, none, none, none, none, none, none)
        upto_a, upto_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        i, j, k, m = upto_a[0], upto_b[0], upto_a[-1], upto_b[-1]
        return cls(True, a[:i], b[:j], a[i:k], b[j:m], np.diff(upto_a), np.diff(upto_b), a[k:], b[m:])

    def then(self, other: Fragment) -> Fragment:
        """Both ranges as one; associative, and a fragment without tokens changes nothing."""
        join = lambda *x: np.concatenate(x)
        if not self.cut:
            return Fragment(other.cut, join(self.head_a, other.head_a), join(self.head_b, other.head_b), *(
                getattr(other, f.name) for f in fields(other)[3:]))
        if not other.cut:
            return Fragment(True, *(getattr(self, f.name) for f in fields(self)[1:7]), join(self.tail_a, other.head_a), join(self.tail_b, other.head_b))
        n_a, n_b = len(self.tail_a) + len(other.head_a), len(self.tail_b) + len(other.head_b)
        return Fragment(
            True, self.head_a, self.head_b, join(self.a, self.tail_a, other.head_a, other.a), join(self.b, self.tail_b, other.head_b, other.b),
            join(self.n_a, [n_a], other.n_a), join(self.n_b, [n_b], other.n_b), other.tail_a, other.tail_b)

    def whole(self):
        """(a, b, n_a, n_b) of a text: its start is a cut too, so the head is its first group."""
        if len(self.tail_a) or len(self.tail_b):
            raise ValueError("a text's last tokens end together")
        return (np.concatenate([self.head_a, self.a]), np.concatenate([self.head_b, self.b]),
                np.concatenate([[len(self.head_a)], self.n_a]).astype(np.int64), np.concatenate([[len(self.head_b)], self.n_b]).astype(np.int64))

    def stored(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Sizes:
    """The number of bytes of each id, by both tokenizers."""
    a: np.ndarray
    b: np.ndarray

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a[a], dtype=np.int64), np.cumsum(self.b[b], dtype=np.int64)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, token of A) of every A and B token that share bytes, in order; texts may follow each other in both.

        Between two neighbouring ends of either kind lies one token of each, and two tokens share one such stretch.
        """
        ends_a, ends_b = self.ends(a, b)
        mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        mark[ends_a] += 1
        mark[ends_b] += 2
        kind = mark[np.flatnonzero(mark)]
        of_a, of_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
        at_a = np.cumsum(of_a) - of_a
        return a[at_a].astype(np.int64) * len(self.b) + b[np.cumsum(of_b) - of_b], at_a


class Tokenizers:
    """Both tokenizers: ids of a text, and the bytes of each id."""
    def __init__(self, definition: str, pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        described = json.loads(definition)["model"]
        letters, special = byte_letters(), {x["id"] for x in json.loads(definition)["added_tokens"]}
        vocabulary = {bytes(letters[c] for c in t): i for t, i in described["vocab"].items() if i not in special}
        merged = [vocabulary[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in described["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids have to follow the order of merges")
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = t
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self._b.id_to_piece(i)) for i in range(self._b.get_piece_size()))]
        self.sizes = Sizes(*(np.array([len(t) for t in x], np.int32) for x in (self.bytes_a, self.bytes_b)))
        # an id with what follows it in the groups' text: a comma inside a group, else the mark that ends its side
        self.text_a, self.text_b = (np.array([f"{i}{mark}".encode() for mark in ("," + end) for i in range(len(x))], object) for x, end in (
            (self.bytes_a, "|"), (self.bytes_b, ";")))

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by both of each text behind a space; none where their bytes aren't the text's."""
        none, out = np.empty(0, np.int32), []
        for text in texts:
            if not text:
                out.append((none, none))
                continue
            a, b = self._a.encode_ordinary(" " + text), self._b.encode(text)
            raw = (" " + text).encode()
            same = b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else (none, none))
        return out

    def digest(self, a, b, n_a, n_b) -> str:
        """sha256 of the groups as text; nothing for no tokens."""
        if not len(a):
            return ""
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.repeat(ends_b - n_b, n_a)] = self.text_a[a + len(self.bytes_a) * last_a]
        parts[np.arange(len(b)) + np.repeat(ends_a, n_b)] = self.text_b[b + len(self.bytes_b) * last_b]
        return hashlib.sha256(b"".join(parts.tolist())[:-1]).hexdigest()


def fragments_of(sizes: Sizes, a: np.ndarray, b: np.ndarray, chunk: int) -> list[Fragment]:
    """A text's tokens by byte ranges of ``chunk``, each a fragment."""
    ends_a, ends_b = sizes.ends(a, b)
    n = max(1, -(-int(ends_a[-1] if len(a) else 0) // chunk))
    if n == 1:
        return [Fragment.of(a, b, ends_a, ends_b)]
    edges = chunk * np.arange(n + 1)
    i, j = np.searchsorted(ends_a, edges, "right"), np.searchsorted(ends_b, edges, "right")
    return [Fragment.of(a[i[k]: i[k + 1]], b[j[k]: j[k + 1]], ends_a[i[k]: i[k + 1]], ends_b[j[k]: j[k + 1]]) for k in range(n)]


def _lists(arrays) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)))


def _part_type() -> pa.DataType:
    return pa.struct([(f.name, pa.bool_() if f.name == "cut" else _INTS) for f in fields(Fragment)])


def _cut(definition, pattern, model, chunk):
    """Batches (row, head, text) to a finished row for each short text, and a row for each fragment of a longer one."""
    def run(batches):
        known, none = Tokenizers(definition, pattern, model), np.empty(0, np.int32)
        for batch in pieces(batches, 256):
            at, chunks, of, ids_a, ids_b, groups, digests, parts = [], [], [], [], [], [], [], []
            for i, (a, b) in enumerate(known.encoded(batch.column("text").to_pylist())):
                found = fragments_of(known.sizes, a, b, chunk)
                for k, fragment in enumerate(found):
                    at.append(i)
                    chunks.append(k)
                    of.append(len(found))
                    short = len(found) == 1
                    whole = fragment.whole() if short and len(a) else (none, none, none, none)
                    ids_a.append(whole[0])
                    ids_b.append(whole[1])
                    groups.append(len(whole[2]))
                    digests.append(known.digest(*whole))
                    parts.append(None if short else fragment.stored())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("head").take(take), pa.array(chunks, pa.int32()), pa.array(of, pa.int32()), _lists(ids_a),
                 _lists(ids_b), pa.array(groups, pa.int64()), pa.array(digests, pa.string()), pa.array(parts, _part_type())],
                names=["row", "head", "chunk", "chunks", "a", "b", "n_groups", "groups_sha256", "part"])

    return run


def _composed(batches):
    """Rows by text, parent and chunk: the fragments of one parent as one, the first's head with it."""
    names = [f.name for f in fields(Fragment)]
    now, value = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [now["row"], now["head"], pa.array([value[0]], pa.int32()), pa.array([value[1].stored()], _part_type())], names=["row", "head", "chunk", "part"])

    for batch in pieces(batches, 16):
        keys = list(zip(batch.column("row").to_pylist(), batch.column("parent").to_pylist(), strict=True))
        for i, key in enumerate(keys):
            part = batch.column("part")[i]
            found = Fragment(part["cut"].as_py(), *(part[n].values.to_numpy() for n in names[1:]))
            if value is not None and value[2] == key:
                value = (value[0], value[1].then(found), key)
                continue
            if value is not None:
                yield row()
            now, value = {c: batch.column(c).slice(i, 1) for c in ("row", "head")}, (key[1], found, key)
    if value is not None:
        yield row()


def _finished(definition, pattern, model):
    """A long text's one fragment to its finished row."""
    def run(batches):
        known, names = Tokenizers(definition, pattern, model), [f.name for f in fields(Fragment)]
        for batch in pieces(batches, 4):
            wholes = [Fragment(p["cut"].as_py(), *(p[n].values.to_numpy() for n in names[1:])).whole() for p in batch.column("part")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("head"), _lists([w[0] for w in wholes]), _lists([w[1] for w in wholes]),
                 pa.array([len(w[2]) for w in wholes], pa.int64()), pa.array([known.digest(*w) for w in wholes], pa.string())],
                names=["row", "head", "a", "b", "n_groups", "groups_sha256"])

    return run


def _tokens(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list column, and the number in each row."""
    column = batch.column(name)
    return column.flatten().to_numpy(), np.array(column.value_lengths(), np.int64)


def _pair_counts(sizes: Sizes):
    def run(batches):
        for batch in pieces(batches, LONG_ROWS * 8):
            pair, n = np.unique(sizes.links(_tokens(batch, "a")[0], _tokens(batch, "b")[0])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return run


def _measured(sizes: Sizes, shared):
    """Finished rows to their numbers, with the links whose pairs aren't held as (pair, n) in ``rest``."""
    def run(batches):
        pairs, counts, is_best = shared.value
        for batch in pieces(batches, LONG_ROWS * 8):
            (a, n_a), (b, n_b) = _tokens(batch, "a"), _tokens(batch, "b")
            pair, at_a = sizes.links(a, b)
            text = np.repeat(np.arange(batch.num_rows), n_a)[at_a]
            place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            held = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
            here, some = text[held], place[held]
            total = np.zeros((2, batch.num_rows), np.int64)
            edges = np.flatnonzero(np.diff(here, prepend=-1))
            for k, values in enumerate((is_best, counts)):
                if len(edges):
                    total[k, here[edges]] = np.add.reduceat(values[some].astype(np.int64), edges)
            rest: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            left, n = np.unique(np.stack([text[~held], pair[~held]]), axis=1, return_counts=True) if not held.all() else (np.empty((2, 0), np.int64), [])
            for i, p, m in zip(left[0].tolist(), left[1].tolist(), list(n), strict=True):
                rest[i].append({"pair": p, "n": int(m)})
            made = [pa.array(x) for x in (n_a, n_b, np.bincount(text, minlength=batch.num_rows).astype(np.int64), *total)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "head", "n_groups", "groups_sha256")), *made, pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))],
                names=["row", "head", "n_groups", "groups_sha256", "n_a", "n_b", "n_links", "n_best", "count_sum", "rest"])

    return run


def aligned(
    docs: DataFrame, definition: str, pattern: str, model: bytes, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    chunk: int = CHUNK_BYTES,
) -> DataFrame:
    """(row, head, a, b, n_groups, groups_sha256) of each row: the ids of both tokenizers, cut into groups where both end.

    ``definition`` and ``pattern`` make the byte-level tokenizer A, which reads a space and the text; ``model`` is the
    piece tokenizer B, which adds the space itself. A text is tokenized whole; ``chunk`` bytes at a time its tokens are
    a fragment. The fragments of longer texts are dealt by text and parent and composed ``FAN_IN`` at a time, level by
    level, in tasks of their own.

    Null and empty texts and those whose tokens don't give back their bytes have no tokens and groups; repeated rows and
    keys are aligned each (``row`` tells them apart, ``head`` holds key and ``keep``); an empty table gives no rows.
    """
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(key, *keep).alias("head"), F.col(text).alias("text"))
    head = f"head {read.schema['head'].dataType.simpleString()}"
    numbers = "a array<int>, b array<int>, n_groups long, groups_sha256 string"
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        cut = saved(read.mapInArrow(_cut(definition, pattern, model, chunk), f"row long, {head}, chunk int, chunks int, {numbers}, part {_PART}"))
    level = cut.where("chunks > 1").select("row", "head", "chunk", "part")
    most = cut.agg(F.max("chunks")).first()[0] or 1
    while most > 1:
        level = level.withColumn("parent", F.floor(F.col("chunk") / FAN_IN).cast("int"))
        level = level.repartition("row", "parent").sortWithinPartitions("row", "chunk").mapInArrow(_composed, f"row long, {head}, chunk int, part {_PART}")
        most = -(-most // FAN_IN)
    done = ["row", "head", "a", "b", "n_groups", "groups_sha256"]
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        long = saved(level.mapInArrow(_finished(definition, pattern, model), f"row long, {head}, {numbers}"))
    return cut.where("chunks = 1").select(*done).unionByName(long.select(*done))


def align(
    docs: DataFrame, definition: str, pattern: str, model: bytes, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
    chunk: int = CHUNK_BYTES, held: int = HELD_PAIRS,
) -> DataFrame:
    """(key, *keep, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, from ``aligned``.

    A link is a pair of A and B tokens that share bytes. Pairs of ids are counted over all texts, batch by batch before
    they are shuffled. The counts of the ``held`` commonest pairs go to every task, whose size this bounds; links of
    other pairs are joined to their counts by pair and summed back by row. n_best are the links whose count is the
    highest of their B id, ties included; count_sum adds up the counts of all links.
    """
    sizes = Tokenizers(definition, pattern, model).sizes
    ids_b = len(sizes.b)
    rows = aligned(docs, definition, pattern, model, key, text, keep, chunk)
    head = f"head {rows.schema['head'].dataType.simpleString()}"
    counts = rows.select("a", "b").mapInArrow(_pair_counts(sizes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        counts = saved(counts)
    best = counts.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B at most
    counts = saved(counts.withColumn("b", F.col("pair") % ids_b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    top = counts.where(F.col("n") >= frequency_floor(counts, "n", held)).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    numbered = rows.mapInArrow(
        _measured(sizes, shared),
        f"row long, {head}, n_groups long, groups_sha256 string, n_a long, n_b long, n_links long, n_best long, count_sum long, rest array<struct<pair:long,n:long>>")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        measured = saved(numbered)
    shared.destroy()
    asked = measured.select("row", F.explode("rest").alias("link")).select("row", "link.pair", F.col("link.n").alias("times"))
    told = asked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    plain = measured.where(F.size("rest") == 0).select("head.*", *numbers, "n_best", "count_sum", "groups_sha256")
    joined = measured.where(F.size("rest") > 0).join(told, "row", "left").select(
        "head.*", *numbers, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
    return plain.unionByName(joined)
