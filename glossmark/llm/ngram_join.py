"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import WORD, packed_row, saved, saved_and_seen, unpacked
from glossmark.llm.rolling import Picker, pick_bits, pieces, shingle_sets

#: Cells of the frequency table that orders shingles, dealt in blocks; fixed size, 4 MB.
CELLS, BLOCK = 1 << 20, 1 << 10
#: Count bins per document for the suffix filter.
BINS = 32
#: Rounds in which one member of each prefix gram stands for the rest.
PIVOT_ROUNDS = 2


def _describe(width: int):
    """Batches (key, text) to one row per document, and counts of its shingles by cell in blocks."""
    def run(batches):
        cells, parts = np.zeros(CELLS, np.int64), []
        for batch in pieces(batches):
            keys, sizes, digests, bins = batch.column(0), [], [], []
            for grams in shingle_sets(batch.column(1), width):
                parts.append(grams)
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                bins.append(np.bincount((grams >> np.uint64(59)).astype(np.int64), minlength=BINS).astype(np.int32).tobytes())
            yield _rows(keys, sizes, digests, bins, None, None)
            if sum(map(len, parts)) > 2 * CELLS:
                cells, parts = cells + counted(parts), []
        cells += counted(parts)
        used = np.flatnonzero(cells.reshape(-1, BLOCK).any(axis=1))
        blocks = cells.reshape(-1, BLOCK)
        for at in range(0, len(used), 256):
            part = used[at: at + 256]
            yield _rows(None, None, None, None, part.tolist(), [blocks[b].tobytes() for b in part])

    def counted(parts):
        every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return np.bincount((every % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)

    def _rows(keys, sizes, digests, bins, block, counts):
        n = len(sizes if sizes is not None else block)
        empty = lambda kind: pa.nulls(n, kind)
        return pa.RecordBatch.from_arrays([
            keys.cast(pa.int64()) if keys is not None else empty(pa.int64()),
            pa.array(sizes, pa.int64()) if sizes is not None else empty(pa.int64()),
            pa.array(digests, pa.binary()) if digests is not None else empty(pa.binary()),
            pa.array(bins, pa.binary()) if bins is not None else empty(pa.binary()),
            pa.array(block, pa.int64()) if block is not None else empty(pa.int64()),
            pa.array(counts, pa.binary()) if counts is not None else empty(pa.binary()),
        ], names=["id", "n", "digest", "bins", "block", "counts"])

    return run


def _added(key, rows):
    import pandas as pd

    total = np.zeros(BLOCK, np.int64)
    for counts in rows["counts"]:
        total += np.frombuffer(counts, np.int64)
    return pd.DataFrame([(key[0], np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes())])


def _cells(described: DataFrame) -> np.ndarray:
    """The count table of all blocks, up to 2^31 - 1 a cell: 4 MB that go through the driver once."""
    blocks = described.where("counts IS NOT NULL").select("block", "counts").groupBy("block").applyInPandas(
        _added, "block long, counts binary")
    cells = np.zeros(CELLS, np.int32)
    for row in blocks.collect():
        cells[row["block"] * BLOCK: (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int32)
    return cells


def _prefixes(width: int, percent: int, cells):
    """Batches (key, text) to the prefix of each document: its rarest shingles by (cell count, digest)."""
    def run(batches):
        counts = cells.value
        for batch in pieces(batches):
            grams, places, sizes = [], [], []
            for found in shingle_sets(batch.column(1), width):
                n = len(found)
                sizes.append(n)
                if not n:
                    grams.append([])
                    places.append(0)
                    continue
                often = counts[(found % np.uint64(CELLS)).astype(np.int64)]
                take = n - -(-percent * n // 100) + 1
                grams.append(found[np.lexsort((found, often))][:take].view(np.int64))
                places.append(int(1000 * np.log2(1.0 + often).mean()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.int64()),
                pa.array(sizes, pa.int64()),
            ], names=["id", "grams", "common", "n"])

    return run


def _verified(width: int, percent: int):
    """Batches (a, b, text_a, text_b) to the pairs whose whole shingle sets are similar enough."""
    def run(batches):
        for batch in pieces(batches):
            left, right, keep = batch.column("text_a").dictionary_encode(), shingle_sets(batch.column("text_b"), width), []
            sets = list(shingle_sets(left.dictionary, width))
            for place, other in zip(left.indices.to_pylist(), right, strict=True):
                one = sets[place] if place is not None else other[:0]
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in ``edges`` (a, b).

    Large-star and small-star steps in turn until the edges stay; each cut off by a table in the shared folder. Their
    number and digest are taken while they are written. Edges that are stars already take one step.
    """
    digest = F.count("*"), F.sum(F.xxhash64("m", "v").cast("decimal(20,0)"))
    ordered = edges.select(F.least("a", "b").alias("m"), F.greatest("a", "b").alias("v")).where("m < v").distinct()
    now, mark = saved_and_seen(ordered, *digest)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("m"), F.col("m").alias("v")))  # (v: node, m: neighbour)
        least = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("least"))
        large = both.where("m > v").join(least, "v").select(F.col("least").alias("m"), F.col("m").alias("v"))
        large = large.where("m < v").distinct()
        down = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(down, "v").select(F.col("least").alias("m"), F.explode(F.array("m", "v")).alias("v"))
        before = mark
        now, mark = saved_and_seen(small.where("m < v").distinct(), *digest)
        if mark == before:
            break
    return now.select(F.col("v").alias("id"), F.col("m").alias("component"))


def _near_enough(percent: int):
    """Length and positional filters on a pair of prefix entries (n, at) of one gram."""
    least = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (rest >= least)


def similarity_groups(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each document; two link when 100 * both >= percent * either.

    Words are lower-cased A-Z; a set holds distinct shingles of ``width`` words, by 64-bit digests. Equal sets are one
    class, joined once. Shingles are ordered by a count table of fixed size, rarest first; a class is indexed under
    the first n - ceil(percent n / 100) + 1 of them, and only pairs that share one, pass the length and positional
    filters and the suffix filter (counts by digest range bound the overlap) are verified on whole texts.

    Within a prefix gram pairs aren't all tried: first every member meets the one with the commonest shingles, and
    links found so far make components; then only members of different components are left to try. A link inside a
    component changes nothing, so components are exact, and a large group costs its size. Components of a round begin at
    those of the round before; a round without new links leaves them as they are.

    Null and empty texts have no shingles and link with nothing; rows that repeat a key are one document with all their
    texts; a null key has no component; an empty table gives no rows. Keys are integers.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described = saved(read.mapInArrow(
        _describe(width), "id long, n long, digest binary, bins binary, block long, counts binary"))
    shared_cells = spark.sparkContext.broadcast(_cells(described))
    rows = described.where("counts IS NULL").select("id", "n", "digest", "bins")
    classes = saved(rows.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("class"), F.first("n").alias("n"), F.first("bins").alias("bins")))

    prefixes = read.mapInArrow(_prefixes(width, percent, shared_cells), "id long, grams array<long>, common long, n long")
    members = prefixes.join(classes.select(F.col("class").alias("id")), "id", "left_semi")
    spread = members.select("id", "n", "common", F.posexplode("grams").alias("at", "gram"))
    entries = saved(spread)
    shared_cells.destroy()
    counts = entries.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1").select("gram")
    shared = saved(entries.join(counts, "gram"))
    labels = components(_same_key(rows, classes))
    tried = None
    for turn in range(PIVOT_ROUNDS + 1):
        named = shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if turn < PIVOT_ROUNDS:
            rank = F.col("common") if turn == 0 else F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 40))
            pivots = named.groupBy("gram").agg(
                F.max(F.struct(rank.alias("rank"), "id", "n", "at", "component")).alias("p"),
                F.min("component").alias("least"), F.max("component").alias("most"))
            pivots = pivots.where("least < most").select("gram", "p.id", "p.n", "p.at", "p.component")
        else:
            split = named.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most"))
            named = named.join(split.where("least < most").select("gram"), "gram")
            pivots = named
        x, y = pivots.alias("x"), named.alias("y")
        ordered = F.col("x.component") != F.col("y.component") if turn < PIVOT_ROUNDS else F.col("x.component") < F.col("y.component")
        pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & ordered & _near_enough(percent)).select(
            F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs, (left,) = saved_and_seen(_suffix_filtered(pairs, classes, percent), F.count("*"))
        if not left:
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        picker = Picker(ids, pick_bits(2 * left))
        links, (new,) = saved_and_seen(_verify(read, pairs, ids, picker, width, percent), F.count("*"))
        picker.release()
        if new:
            labels = components(links.unionByName(labels.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    by_class = classes.select("digest", "class").join(labels.withColumnRenamed("id", "class"), "class", "left").select(
        "digest", F.coalesce("component", "class").alias("component"))
    return rows.join(by_class, "digest", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _same_key(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a key with other texts: they are one document."""
    several = rows.where("n > 0").groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where(
        "id IS NOT NULL AND one != other").select("id")
    named = rows.join(several, "id").join(classes.select("digest", "class"), "digest").groupBy("id").agg(
        F.min("class").alias("a"), F.collect_set("class").alias("all"))
    return named.select("a", F.explode("all").alias("b")).where("a != b").distinct()


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose counts by digest range leave room for enough common shingles."""
    a = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a"))
    b = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b"))

    def run(batches):
        for batch in pieces(batches):
            left = np.frombuffer(b"".join(batch.column("bins_a").to_pylist()), np.int32).reshape(-1, BINS)
            right = np.frombuffer(b"".join(batch.column("bins_b").to_pylist()), np.int32).reshape(-1, BINS)
            most = np.minimum(left, right).sum(axis=1)
            room = 100 * most >= percent * (left.sum(axis=1) + right.sum(axis=1) - most)
            yield batch.select(["a", "b"]).filter(pa.array(room))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "bins_a", "bins_b").mapInArrow(run, "a long, b long")


def _verify(read: DataFrame, pairs: DataFrame, ids: DataFrame, picker: Picker, width: int, percent: int) -> DataFrame:
    """The pairs that hold on whole texts. Texts are picked by a bit table first, then by join."""
    picked = read.where("id IS NOT NULL").where(picker(F.col("id")))
    texts = picked.join(ids, "id", "left_semi")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_verified(width, percent), "a long, b long").distinct()


def one_of_each(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the row whose key is the group's smallest.

    Rows without shingles or without a key are in no group and stay; of rows that repeat the smallest key, one stays.
    """
    groups = similarity_groups(docs, width, percent, key, text)
    gone = saved(groups.where(F.col(key).isNotNull() & (F.col(key) != F.col("component_id"))).select(F.col(key).alias("_key")).distinct())
    rows = docs.select(packed_row(docs), F.col(key).alias("_key"), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("_words"))
    twice = saved(rows.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    left = rows.join(gone, "_key", "left_anti")
    again = left.join(twice, "_key", "left_semi")
    parts = [left.join(twice, "_key", "left_anti"), again.where("_words").dropDuplicates(["_key"]), again.where("NOT _words")]
    first, second, third = (p.select("_doc") for p in parts)
    return first.unionByName(second).unionByName(third).select(*unpacked(docs))
