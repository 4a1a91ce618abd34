"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import saved
from glossmark.llm.rolling import Picker, bit_tables, has_bit, pieces, split_words, turned_away, window_digests, word_digests

#: Bits of each of the two anchor tables (32 MB each). They only spare work: beyond some hundred million blocks they
#: let more windows through to the exact count, whose results don't depend on them.
ANCHOR_BITS = 28


def _blocks(block: int, bits: int, copies):
    """Batches (text, slot) to the two table slots of each non-overlapping block, counted per task."""
    def run(batches):
        parts = []
        for batch in pieces(batches):
            for digests in word_digests(turned_away(batch, copies.value).column("text")):
                parts.append(_slots(window_digests(digests, block)[::block], bits).ravel())
            if sum(map(len, parts)) > 1_000_000:
                yield from _counted(parts)
                parts = []
        yield from _counted(parts)

    return run


def _counted(parts):
    if parts:
        slots, n = np.unique(np.concatenate(parts), return_counts=True)
        for at in range(0, len(slots), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[at: at + 100_000].astype(np.int64)), pa.array(n[at: at + 100_000])], names=["slot", "n"])


def _slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two slots for each digest, from its upper and its lower bits."""
    return np.stack([digests >> np.uint64(64 - bits), digests & np.uint64((1 << bits) - 1)])


def _probe(width: int, block: int, bits: int, tables, copies):
    """Batches (row, text, slot) to the windows of ``width`` words that hold an anchor's words.

    A block's own place always meets itself, so there the anchor must have been seen twice.
    """
    def run(batches):
        once, twice = tables.value
        for batch in pieces(batches):
            batch = turned_away(batch, copies.value)
            rows, starts, first, second = [], [], [], []
            for row, digests in zip(batch.column("row").to_pylist(), word_digests(batch.column("text")), strict=True):
                if len(digests) < width:
                    continue
                slots = _slots(window_digests(digests, block), bits)
                hit = has_bit(once, slots[0]) & has_bit(once, slots[1])
                own = np.arange(0, len(hit), block)
                hit[own] = has_bit(twice, slots[0][own]) & has_bit(twice, slots[1][own])
                seen = np.concatenate([[0], np.cumsum(hit)])
                n = len(digests) - width + 1
                at = np.flatnonzero(seen[width - block + 1:][:n] > seen[:n])
                if len(at):
                    rows.append(np.full(len(at), row))
                    starts.append(at)
                    first.append(window_digests(digests, width)[at].view(np.int64))
                    second.append((window_digests(digests ^ np.uint64(0xA5A5A5A5A5A5A5A5), width)[at] >> np.uint64(33)).astype(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(first)), pa.array(np.concatenate(second)),
                    pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(starts).astype(np.int32)),
                ], names=["h", "g", "row", "at"])

    return run


def repeat_starts(texts: DataFrame, copies, width: int, block: int, bits: int = ANCHOR_BITS) -> DataFrame:
    """(row, starts): where the words of a window of ``width`` start that also start anywhere else.

    ``texts`` has row, text and slot; rows whose slot is in the bit table ``copies`` are left out in the task, so
    that each distinct text is read once. Every window of ``width`` words holds a whole block of some block grid if
    2 * block - 1 <= width, so of two equal windows each holds the words of an anchor of the other's text.
    Windows without an anchor drop out in the scan; the rest are counted by a 95-bit digest, in all texts,
    and those seen twice go back to their rows. No pairs are made: a passage costs its occurrences.
    """
    assert 2 * block - 1 <= width
    spark = texts.sparkSession
    slots = texts.select("text", "slot").mapInArrow(_blocks(block, bits, copies), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    tables = spark.sparkContext.broadcast(bit_tables(slots, bits, 2))
    windows = saved(texts.select("row", "text", "slot").mapInArrow(
        _probe(width, block, bits, tables, copies), "h long, g int, row long, at int"))
    # written, so that the join reads plain shuffles on both sides and its hot windows can be split
    again = saved(windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"))
    return windows.join(again, ["h", "g"]).groupBy("row").agg(F.collect_list("at").alias("starts"))


def _kept(width: int, concerned):
    """Batches (key, text, copied, starts, slot) to word counts and what stays."""
    def run(batches):
        for batch in pieces(batches):
            batch = turned_away(batch, concerned.value)
            out = []
            for text, copies, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "copied", "starts")), strict=True):
                words = split_words(text)
                gone = np.zeros(len(words) + 1, np.int32)
                if copies and len(words) >= width:
                    gone[0] += 1
                for at in starts or ():
                    gone[at] += 1
                    gone[at + width] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                left = [w for w, k in zip(words, keep, strict=True) if k]
                out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.string())], names=["key", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = 35, block: int = 18, bits: int = ANCHOR_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept) of each row: its words without those in a window that starts anywhere else too.

    Windows are judged on the input, over all rows, the same text included; maximal repeats are the unions of their
    windows. Texts that are equal as a whole go through once, and all their words are removed if they
    have a window. Null texts have no words; repeated rows are copies of each other; an empty table gives no rows.
    """
    copy = F.sha2(F.coalesce(text, F.lit("")), 256)
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(copy).alias("row"))
    copied = saved(read.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(True).alias("copied")))
    is_copy = Picker(copied.select("row"))
    all_texts = read.select("row", "text", is_copy.slot(F.col("row")).alias("slot"))
    first = read.where(is_copy(F.col("row"))).groupBy("row").agg(F.first("text").alias("text"))
    texts = all_texts.unionByName(first.select("row", "text", F.lit(-1).cast("long").alias("slot")))
    starts = saved(repeat_starts(texts, is_copy.shared, width, block, bits))
    concerned = Picker(copied.select("row").unionByName(starts.select("row")))
    names = ("key", "text", "copied", "starts", "slot")
    rows = read.where(concerned(F.col("row"))).join(starts, "row", "left").join(copied, "row", "left")
    clear = read.withColumns({"starts": F.lit(None).cast("array<int>"), "copied": F.lit(None).cast("boolean")})
    parts = rows.withColumn("slot", F.lit(-1).cast("long")).select(*names).unionByName(
        clear.withColumn("slot", concerned.slot(F.col("row"))).select(*names))
    kind = docs.schema[key].dataType.simpleString()
    return parts.mapInArrow(_kept(width, concerned.shared), f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)
