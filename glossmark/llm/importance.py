"""Target-distribution importance resampling: hashed n-gram gains of a target over the corpus, and a seeded draw."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import packed_row, saved, unpacked
from glossmark.llm.rolling import pieces

#: Bytes of text that share one table of n-grams, about, and occurrences that are interned at once.
_TEXT_AT_ONCE, _AT_ONCE = 1 << 21, 1 << 18
#: Byte by byte: what a word keeps (0-9, a-z, and all of a character beyond ASCII), A-Z lower-cased; gaps are spaces.
_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values: the primes of the 64-bit hash
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Spans:
    """Byte runs of one buffer, read in lanes of 1 to 8 bytes."""
    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eight = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def lanes(self, at: np.ndarray, size: int) -> np.ndarray:
        """The ``size`` bytes from each place on, as one number."""
        value = self._eight[at]
        return value if size == 8 else value & np.uint64((1 << (8 * size)) - 1)

    def keys(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """xxhash64 of each run: runs of one size at once below 32 bytes, longer ones one by one."""
        out = np.empty(len(starts), np.uint64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
            some, size = order[low:high], int(sizes[order[low]])
            if size < 32:
                out[some] = self._short(starts[some], size)
            else:
                out[some] = [xxhash.xxh64_intdigest(self.data[s: s + size].tobytes()) for s in starts[some].tolist()]
        return out

    def _short(self, at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), _P5 + np.uint64(size), np.uint64)
        done = 0
        while size - done >= 8:
            h = _turned(h ^ (_turned(self.lanes(at + done, 8) * _P2, 31) * _P1), 27) * _P1 + _P4
            done += 8
        if size - done >= 4:
            h = _turned(h ^ (self.lanes(at + done, 4) * _P1), 23) * _P2 + _P3
            done += 4
        for i in range(done, size):
            h = _turned(h ^ (self.lanes(at + i, 1) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))

    def same(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the runs from a and from b hold the same bytes."""
        equal = np.ones(len(a), bool)
        left = np.arange(len(a))
        done = 0
        while len(left):
            rest = np.minimum(sizes[left] - done, 8).astype(np.uint64)
            differ = self._eight[a[left] + done] ^ self._eight[b[left] + done]
            differ = differ << ((np.uint64(8) - rest) * np.uint64(8))
            equal[left[differ != 0]] = False
            done += 8
            left = left[(sizes[left] > done) & equal[left]]
        return equal


class GramTable:
    """N-grams of one buffer, each in one slot of an open-addressed table that doubles when half full.

    A slot holds the xxhash64 key, where the n-gram's bytes stand, its bucket and its count. Equal keys are one n-gram
    only if their bytes are equal; others go on to the next slot.
    """
    def __init__(self, spans: Spans, buckets: int, size: int = 1 << 12):
        self.spans, self.buckets, self.used = spans, buckets, 0
        self._empty(size)

    def _empty(self, size: int) -> None:
        self.key, self.start = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        self.size, self.bucket, self.count = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)

    def intern(self, starts: np.ndarray, sizes: np.ndarray, count: bool = True) -> np.ndarray:
        """The slot of each occurrence's n-gram; new ones enter, with their bucket, and counts go up."""
        keys = self.spans.keys(starts, sizes)
        while 2 * (self.used + len(keys)) > len(self.key) and self._grown(len(keys)):
            pass
        slots, fresh = self._placed(keys, starts, sizes)
        self.used += len(fresh)
        data = self.spans.data
        self.bucket[fresh] = [zlib.crc32(data[s: s + n]) % self.buckets for s, n in zip(self.start[fresh].tolist(), self.size[fresh].tolist(), strict=True)]
        if count:
            self.count += np.bincount(slots, minlength=len(self.key))
        return slots

    def _grown(self, more: int) -> bool:
        """Twice the slots, if what is held and ``more`` wouldn't fit in half of them; slot numbers change."""
        if 2 * (self.used + more) <= len(self.key):
            return False
        held = np.flatnonzero(self.start >= 0)
        key, start, size, bucket, count = (x[held] for x in (self.key, self.start, self.size, self.bucket, self.count))
        self._empty(2 * len(self.key))
        slots, _ = self._placed(key, start, size)
        self.bucket[slots], self.count[slots] = bucket, count
        return True

    def _placed(self, keys, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.key) - 1)
        slots = (keys & mask).astype(np.int64)
        left, fresh = np.arange(len(keys)), []
        while len(left):
            at = slots[left]
            free = self.start[at] < 0
            asking, wanted = left[free], at[free]
            self.start[wanted] = starts[asking]  # of several that ask for a slot one stays; all are compared with it below
            owner = np.zeros(len(self.key), bool)
            owner[wanted] = True
            first = asking[self.start[wanted] == starts[asking]]
            self.key[slots[first]], self.size[slots[first]] = keys[first], sizes[first]
            fresh.append(np.flatnonzero(owner))
            same = (self.key[at] == keys[left]) & (self.size[at] == sizes[left])
            maybe = np.flatnonzero(same)
            same[maybe] = self.spans.same(self.start[at[maybe]], starts[left[maybe]], sizes[left[maybe]])
            left = left[~same]
            slots[left] = (slots[left] + 1) & int(mask)
        return slots, np.concatenate(fresh) if fresh else np.empty(0, np.int64)


def _tables(batches):
    """Batches cut by bytes of text, so that one table's texts stay small; a longer text is one of its own."""
    for batch in pieces(batches):
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _TEXT_AT_ONCE, "right")))
            yield batch.slice(at, n)
            at += n


class _Words:
    """The words of a string column: where each starts and ends in one buffer that joins words by one space, and its text."""
    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        data = _FOLD[np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]: edges[-1]]]
        edges = edges - edges[0]
        solid = data != 32
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        firsts = edges[:-1][edges[:-1] < edges[1:]]
        opens[firsts] = solid[firsts]
        place = np.cumsum(solid)  # bytes of words up to here
        sizes = np.diff(np.append(place[opens] - 1, place[-1] if len(place) else 0))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        joined = np.full(int(self.ends[-1]) + 1 if len(sizes) else 0, 32, np.uint8)
        joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[solid]
        self.spans = Spans(joined)
        upto = np.concatenate([[0], np.cumsum(opens)])[edges]
        self.per_text = np.diff(upto)
        self.text = np.repeat(np.arange(len(column)), self.per_text)

    def runs(self, longest: int):
        """(starts, sizes, texts) of all runs of 1 to ``longest`` words inside one text, in parts."""
        for k in range(longest):
            first = np.arange(max(len(self.starts) - k, 0))
            first = first[self.text[first] == self.text[first + k]]
            for at in range(0, len(first), _AT_ONCE):
                f = first[at: at + _AT_ONCE]
                yield self.starts[f], self.ends[f + k] - self.starts[f], self.text[f]


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all the texts fall in each bucket that has any. Bounded by ``buckets`` rows."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in _tables(batches):
            words = _Words(batch.column("text"))
            table = GramTable(words.spans, buckets)
            for starts, sizes, _ in words.runs(longest):
                table.intern(starts, sizes)
            total += np.bincount(table.bucket, table.count, minlength=buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Each bucket's gain, floor(1000 ln of the target's smoothed share over the corpus's), from two ``bucket_counts``."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # at most ``buckets`` rows
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in rows:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def noise(key: str, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 8 hex digits of sha256(seed:key); a null key is the empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def weighed(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, seed: str = "2024",
) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Features are all runs
    of 1 to ``longest`` consecutive words joined by one space; crc32 of their bytes modulo ``buckets`` is their bucket.
    In each Arrow batch a table of slots interns the n-grams; occurrences then gather the gain of their slot. The weight is
    the floored mean of gains, 0 without features; the score adds seeded noise. Counts cover all texts on both sides; only
    a table of ``buckets`` numbers goes through the driver and to the tasks.

    Null and empty texts have no features; a null key has the noise of the empty key; repeated rows are counted and
    weighed each; an empty target weighs by the corpus alone; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)

    def run(batches):
        of_bucket = np.array(gain, np.int64)
        for batch in _tables(batches):
            words = _Words(batch.column("text"))
            table = GramTable(words.spans, buckets)
            total, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for starts, sizes, texts in words.runs(longest):
                slots = table.intern(starts, sizes, count=False)
                edges = np.flatnonzero(np.diff(texts, prepend=-1))
                total[texts[edges]] += np.add.reduceat(of_bucket[table.bucket[slots]], edges)
                n += np.bincount(texts, minlength=batch.num_rows)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            made = [pa.array(x.astype(np.int64)) for x in (words.per_text, n, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n_words", "n_features", "weight"])

    kind = docs.select(F.col(key).alias("id")).schema["id"].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long")
    score = (F.col("weight") + noise("id", seed)).cast("long")
    return rows.select("*", score.alias("score")).withColumnRenamed("id", key)


def ranked(rows: DataFrame, key: str = "doc_id", percent: int = 10, least_words: int = 20) -> DataFrame:
    """``rows`` of ``weighed`` with their rank: the ``percent`` highest scores of rows with ``least_words`` words or more,
    floored in number, from 1, ties to the smaller key (null first); others have a null rank.

    No task orders all rows: scores are whole thousandths of bounded logarithms, some 200,000 values at most, so a count
    per score gives the offset of each; only rows of one score are ordered together, equal rows as one.
    """
    rows = saved(rows)
    per_score = rows.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long")
    offsets = saved(per_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), most.alias("most")))
    offsets = offsets.where("before < most")
    asked = F.col("n_words") >= least_words
    same = rows.where(asked).join(F.broadcast(offsets), "score").groupBy(*rows.columns, "before", "most").agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy(F.col(key), *[F.col(c) for c in ("n_features", "weight")])
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    drawn = same.withColumn("_upto", upto).select(*rows.columns, "most", F.explode(F.sequence(
        F.col("_upto") - F.col("n") + 1, F.col("_upto"))).alias("rank"))
    drawn = drawn.select(*rows.columns, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank"))
    rest = rows.where(~asked).select("*", F.lit(None).cast("long").alias("rank"))
    below = rows.where(asked).join(F.broadcast(offsets.select("score")), "score", "left_anti").select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).unionByName(below)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 10, least_words: int = 20, **settings) -> DataFrame:
    """The drawn rows of ``docs``, each once, all columns as they are. A key that rows share is drawn with all of them."""
    chosen = ranked(weighed(docs, target, key, text, **settings), key, percent, least_words).where("rank IS NOT NULL")
    chosen = chosen.select(F.col(key).alias("_key")).distinct()
    rows = docs.select(packed_row(docs), F.col(key).alias("_key"))
    return rows.join(chosen, rows["_key"].eqNullSafe(chosen["_key"]), "left_semi").select(*unpacked(docs))
