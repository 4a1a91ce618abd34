"""Exact top-k search by a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import saved

#: Vectors that the pivots are fitted on, at most (by digest of the key), and pivots.
FIT_ROWS, PIVOTS = 4096, 64
#: Vectors in an annulus and queries in a block, about.
RING, QUERY_BLOCK = 2048, 1024
#: Room for rounding in a bound on distances.
SLACK = 1e-6


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles that hold integers; null if the vector or one of them is unfit."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fit = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fit, F.transform(doubles, lambda x: F.floor(x * scale).cast("double")))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component that gives every vector the norm ``top``: then nearer means a larger product."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays under 2 ** 53, else in Python's integers."""
    if (np.abs(x).max(initial=0) * np.abs(y).max(initial=0)) * max(x.shape[1], 1) < 2**53:
        return (x @ y.T).astype(np.int64)
    # doubles as objects would multiply as doubles
    return x.astype(np.int64).astype(object) @ y.astype(np.int64).astype(object).T


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """A spread choice: each next pivot is the sampled vector farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    away = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _ranked(k: int) -> Window:
    return Window.partitionBy("query_id", "query_at").orderBy(F.col("score").desc(), "vec_id")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest products with every row but itself.

    ``queries`` picks the query rows. Vectors are lifted to one norm, so that the largest product is the least distance.
    Every distinct vector is keyed by its nearest pivot and its distance to it, and stands in an annulus of about
    ``RING`` neighbours by that key. A query first meets the annuli of its nearest pivot that lie closest to its
    own distance; its k-th score so far is a radius. It then meets just the annuli that the triangle
    inequality can't rule out under that radius. Pivots are fitted on a bounded sample; every row is indexed and
    the bounds are safe, so results are exact.

    Equal vectors are indexed once with their k + 1 smallest keys: no more of them can be among k results. Ties go to
    smaller keys. Vectors that are null or hold null or non-finite components take no part; shorter ones count as
    ending in zeros; rows that repeat a key are rows of their own; an empty table gives no rows. Vectors whose squared length
    reaches 2**63 after scaling are refused, since their products may not fit a long.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col(key).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("v"), queries.alias("asks"))
    rows = saved(read.where("v IS NOT NULL AND vec_id IS NOT NULL"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("width")).first()
    total, top, width = stats["n"], stats["top"] or 0.0, stats["width"] or 0
    if top >= 2.0**63:
        raise ValueError("scores of these vectors may pass 64 bits: the largest squared length is 2**63 or more")
    share = min(1.0, FIT_ROWS / max(total, 1))
    fit = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toArrow()["v"].combine_chunks()
    pivots = spark.sparkContext.broadcast(_pivots(_lifted(_matrix(fit, width), top), PIVOTS))

    # one row per distinct vector, with the smallest keys that can matter
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.select("v", "vec_id").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= k + 1)
    distinct = distinct.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def keyed(batches):
        for batch in batches:
            x = _lifted(_matrix(batch.column("v"), width), top)
            away = _distances(x, pivots.value)
            near = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), batch.column("ids"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(x)), near])],
                names=["v", "ids", "pivot", "away"])

    index = saved(distinct.mapInArrow(keyed, "v array<double>, ids array<long>, pivot int, away double"))
    # annuli: distance ranges of a pivot of about RING vectors, cut at approximate quantiles of its distances
    per = index.groupBy("pivot").agg(F.count("*").alias("n"))
    most = per.agg(F.max("n")).first()[0] or 0
    cuts = min(1024, max(1, -(-most // RING)))
    marks = index.groupBy("pivot").agg(F.percentile_approx(
        "away", F.array(*[F.lit(i / cuts) for i in range(1, cuts)]) if cuts > 1 else F.array(F.lit(0.5)), 4096).alias("marks"))
    ring = F.size(F.filter("marks", lambda m: m < F.col("away"))) if cuts > 1 else F.lit(0)
    # where many vectors are equally far, a digest splits the annulus further
    placed = index.join(F.broadcast(marks), "pivot").withColumn("ring", ring.cast("int"))
    sizes = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    placed = placed.join(sizes, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / (2 * RING))).cast("int"))
    annuli = saved(placed.groupBy("pivot", "ring", "part").agg(
        F.min("away").alias("inner"), F.max("away").alias("outer"), F.count("*").alias("n"),
        F.collect_list(F.struct("v", "ids")).alias("held")))
    bounds = annuli.select("pivot", "ring", "part", "inner", "outer", "n")

    asked = rows.where("asks").groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("at", F.xxhash64("v"))
    blocks = asked.count() // QUERY_BLOCK + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def to_pivots(batches):
        for batch in batches:
            x = _lifted(_matrix(batch.column("v"), width), 0.0)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("vec_id", "at", "block", "times", "v")), pa.array(_distances(x, pivots.value).tolist(), pa.list_(pa.float64()))],
                names=["vec_id", "at", "block", "times", "v", "to_pivots"])

    # a query has no lift of its own: its last component is 0
    asked = saved(asked.mapInArrow(to_pivots, "vec_id long, at long, block long, times long, v array<double>, to_pivots array<double>"))
    table = bounds.groupBy("pivot").agg(F.collect_list(F.struct("ring", "part", "inner", "outer", "n")).alias("rings"))
    gap = lambda d, r: F.greatest(F.lit(0.0), d - r["outer"], r["inner"] - d)

    spread = asked.select("vec_id", "at", F.posexplode("to_pivots").alias("pivot", "d"))
    near = spread.groupBy("vec_id", "at").agg(F.min_by("pivot", F.struct("d", "pivot")).alias("pivot"), F.min("d").alias("d"))
    opening = near.join(F.broadcast(table), "pivot").select("vec_id", "at", "pivot", F.slice(F.array_sort(F.transform("rings", lambda r: F.struct(
        gap(F.col("d"), r).alias("gap"), r["ring"].alias("ring"), r["part"].alias("part")))), 1, 2).alias("rings")).select(
        "vec_id", "at", "pivot", F.explode("rings").alias("r")).select("vec_id", "at", "pivot", "r.ring", "r.part", F.lit(None).cast("double").alias("radius"))
    found = saved(_met(opening, asked, annuli, k, width, top))
    best = found.withColumn("rank", F.row_number().over(_ranked(k))).where(F.col("rank") <= k)
    kth = best.groupBy("query_id", "query_at").agg(F.count("*").alias("got"), F.min("score").alias("least"))
    norms = asked.select("vec_id", "at", "to_pivots", square.alias("square"))
    radius = F.when(F.col("got") >= k, F.sqrt(F.greatest(F.col("square") + top - 2 * F.col("least").cast("double"), F.lit(0.0))))
    known = norms.join(kth.withColumnsRenamed({"query_id": "vec_id", "query_at": "at"}), ["vec_id", "at"], "left").withColumn("radius", radius)
    left = known.select("vec_id", "at", "radius", F.posexplode("to_pivots").alias("pivot", "d")).join(F.broadcast(table), "pivot")
    left = left.select("vec_id", "at", "pivot", "radius", F.explode(F.filter("rings", lambda r: F.col("radius").isNull() | (
        gap(F.col("d"), r) <= F.col("radius") * (1 + SLACK) + SLACK))).alias("r")).select("vec_id", "at", "pivot", "r.ring", "r.part", "radius")
    left = left.join(opening.select("vec_id", "at", "pivot", "ring", "part"), ["vec_id", "at", "pivot", "ring", "part"], "left_anti")
    every = found.unionByName(_met(left, asked, annuli, k, width, top)).withColumn("rank", F.row_number().over(_ranked(k)))
    times = asked.where("times > 1").select(F.col("vec_id").alias("query_id"), F.col("at").alias("query_at"), "times")
    best = every.where(F.col("rank") <= k).join(times, ["query_id", "query_at"], "left")
    return best.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))).select(
        "query_id", "rank", "vec_id", "score")


def _met(pairs: DataFrame, asked: DataFrame, annuli: DataFrame, k: int, width: int, top: float) -> DataFrame:
    """The k best of each annulus for the queries that meet it, blocks of queries at a time."""
    asks = pairs.join(asked.select("vec_id", "at", "block", "v"), ["vec_id", "at"]).groupBy("pivot", "ring", "part", "block").agg(
        F.collect_list(F.struct("vec_id", "at", "v", "radius")).alias("asks"))
    both = asks.join(annuli.select("pivot", "ring", "part", "held"), ["pivot", "ring", "part"]).select("asks", "held")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asks, held = batch.column("asks")[i].values, batch.column("held")[i].values
                x, y = _matrix(asks.field("v"), width), _matrix(held.field("v"), width)
                scores, ids, out = _products(x, y), held.field("ids").to_pylist(), []
                for j, (own, at) in enumerate(zip(asks.field("vec_id").to_pylist(), asks.field("at").to_pylist(), strict=True)):
                    row = scores[j]
                    take = np.argsort(-row) if row.dtype == object else _largest(row, k + 1)
                    found = sorted((-int(row[c]), key) for c in take for key in (
                        _others(ids[c], own) if own in ids[c] and (x[j] == y[c]).all() else ids[c]))[:k]
                    out += [(own, at, key, -score) for score, key in found]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=["query_id", "query_at", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, query_at long, vec_id long, score long")


def _largest(row: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest values and of all that tie with the last of them."""
    if len(row) <= count:
        return np.arange(len(row))
    return np.flatnonzero(row >= np.partition(row, len(row) - count)[len(row) - count])


def _others(ids: list[int], own: int) -> list[int]:
    """The keys without one occurrence of the query's own."""
    at = ids.index(own)
    return ids[:at] + ids[at + 1:]
