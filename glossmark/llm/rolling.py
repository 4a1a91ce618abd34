"""Word and window digests of whole texts, and bit tables of fixed size. Used inside Arrow functions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, bytes(b + 32 for b in _UPPER))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of the step modulo 2**64, so that window sums come from one prefix sum.
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A fixed 64-bit value for each byte, as it is and lower-cased.
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BYTE_LOWER = _BYTE[np.frombuffer(bytes(range(256)).translate(_TO_LOWER), np.uint8)]
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes of text that are digested at once.
_AT_ONCE = 1 << 19


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words by the shared rule: bytes.split() cuts at U+0020 and U+0009 to U+000D."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_TO_LOWER) if lower else raw).split()


def pieces(batches, rows: int = 512):
    """Batches cut into small ones, so that what is held for one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Powers:
    """Powers of a factor modulo 2**64, as many as were asked for so far."""
    def __init__(self, factor: np.uint64):
        self.factor, self.known = factor, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.full(max(n, 2 * len(self.known)), self.factor, np.uint64)
            self.known[0] = 1
            np.cumprod(self.known, out=self.known)
        return self.known[:n]


_UP, _DOWN = _Powers(_STEP), _Powers(_BACK)


def word_digests(column: pa.Array, lower: bool = False):
    """The word digests of each text of a string column, in turn; a null text has none."""
    lengths = np.array(pc.fill_null(pc.binary_length(column), 0), np.int64)
    at = 0
    while at < len(column):
        size = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), _AT_ONCE)))
        yield from _digested(column.slice(at, size), lower)
        at += size


def _digested(column: pa.Array, lower: bool):
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]: edges[-1]]
    edges = edges - edges[0]
    solid = ~_IS_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    firsts = edges[:-1][edges[:-1] < edges[1:]]
    opens[firsts] = solid[firsts]
    place = np.cumsum(solid) - 1  # of each byte among those of words
    starts = place[opens]
    within = _BYTE_LOWER[data[solid]] if lower else _BYTE[data[solid]]
    sizes = np.diff(np.append(starts, len(within)))
    inside = np.arange(len(within)) - np.repeat(starts, sizes)
    powers = _UP(int(sizes.max(initial=1)))
    digests = mixed_bits(np.add.reduceat(within * powers[inside], starts)) if len(starts) else np.empty(0, np.uint64)
    upto = np.concatenate([[0], np.cumsum(opens)])[edges]
    for i in range(len(column)):
        yield digests[upto[i]: upto[i + 1]]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_digests(digests: np.ndarray, width: int) -> np.ndarray:
    """One digest per run of ``width`` words: a polynomial of the word digests, from one prefix sum."""
    n = len(digests) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(digests) + 1, np.uint64)
    np.cumsum(digests * _DOWN(len(digests)), out=total[1:])
    return mixed_bits((total[width:] - total[:-width]) * _UP(n))


def shingle_sets(column: pa.Array, width: int):
    """Sorted distinct digests of each lower-cased text's shingles; one for a shorter sequence, none without words."""
    for words in word_digests(column, lower=True):
        if 0 < len(words) < width:
            yield window_digests(words, len(words)) ^ np.uint64(len(words))
        else:
            yield np.unique(window_digests(words, width))


def bit_tables(counts: DataFrame, bits: int, levels: int = 1) -> list[np.ndarray]:
    """Bit tables of ``2 ** bits`` bits from rows (slot, n): table k has the slots whose n is k or more.

    They are made in segments on the executors; their size is fixed by ``bits``, whatever the data.
    """
    segment = 1 << min(bits, 19)

    def fill(key, rows):
        slot, n = rows["slot"].to_numpy() % segment, rows["n"].to_numpy()
        out = []
        for level in range(1, levels + 1):
            flags = np.zeros(segment, np.uint8)
            flags[slot[n >= level]] = 1
            out.append(np.packbits(flags, bitorder="little").tobytes())
        return pd.DataFrame([(key[0], *out)])

    schema = "segment long, " + ", ".join(f"t{k} binary" for k in range(levels))
    made = counts.groupBy(F.floor(F.col("slot") / segment).cast("long").alias("segment")).applyInPandas(fill, schema).collect()
    tables = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(levels)]
    for row in made:
        for k in range(levels):
            at = row["segment"] * segment // 8
            tables[k][at: at + segment // 8] = np.frombuffer(row[f"t{k}"], np.uint8)
    return tables


def has_bit(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Bits of a table that picks rows before a join (8 MB at most); only a saving, the join behind it decides.
PICK_BITS = 26


def pick_bits(keys: int) -> int:
    """Bits for about so many keys: 32 slots or more for each, up to ``PICK_BITS``."""
    return min(PICK_BITS, max(13, (32 * keys).bit_length()))


class Picker:
    """Tells longs that are surely not in ``keys`` (one column of longs), by a bit table in every task.

    Rows that it turns away need not be shuffled to the join that decides on the others.
    """

    def __init__(self, keys: DataFrame, bits: int = PICK_BITS):
        self.bits = bits
        name, = keys.columns
        slots = keys.where(F.col(name).isNotNull()).select(self.slot(F.col(name)).alias("slot")).distinct()
        table, = bit_tables(slots.withColumn("n", F.lit(1)), bits)
        self.shared = shared = keys.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("boolean")
        def test(slot: pd.Series) -> pd.Series:
            return pd.Series(has_bit(shared.value, slot.to_numpy().astype(np.uint64)))

        self._test = test

    def release(self) -> None:
        """Takes the table from the tasks and the driver."""
        self.shared.destroy()

    def slot(self, column):
        return F.pmod(F.xxhash64(column), F.lit(1 << self.bits))

    def __call__(self, column):
        """A boolean column: false where the long is surely not in."""
        return self._test(self.slot(column))


def turned_away(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """The rows whose ``slot`` is below 0 or not in the table: the filter for functions that read whole batches."""
    slots = batch.column("slot").to_numpy()
    return batch.filter(pa.array((slots < 0) | ~has_bit(table, np.maximum(slots, 0).astype(np.uint64))))


#: Distinct words that a task counts before it passes them on.
_COUNTED = 500_000


def word_counts(texts: DataFrame, lower: bool = False) -> DataFrame:
    """(word, n) over all words of the one text column; words as bytes, counted in each task before the shuffle."""
    def run(batches):
        found = Counter()
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                found.update(split_words(text, lower))
                if len(found) > _COUNTED:
                    yield from rows(found)
                    found = Counter()
        yield from rows(found)

    def rows(found):
        words, n = list(found), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at: at + 50_000], pa.binary()), pa.array(n[at: at + 50_000], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
