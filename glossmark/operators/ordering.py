"""Exact ranks and order statistics that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.session import checkpointed


def rank_by_hash(
    rows: DataFrame,
    digest: str,
    groups: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
    ties: Sequence[str] = (),
    digits: int = 3,
) -> DataFrame:
    """Add the 1-based position by ``digest`` inside each group, and the group's size.

    Digests are spread evenly, so their first hex digits cut a group into
    ``16**digits`` parts of like size: rank inside the part, then add the rows of
    the parts before it.  Only the part counts (a bounded number per group) meet
    in one window partition.
    """
    part = "_part"
    cut = rows.withColumn(part, F.substring(digest, 1, digits))
    counts = cut.groupBy(*groups, part).agg(F.count("*").alias("_n"))
    by_part = Window.partitionBy(*groups).orderBy(part)
    if groups:
        whole = Window.partitionBy(*groups)
    else:
        whole = Window.partitionBy(F.lit(1))
        by_part = Window.partitionBy(F.lit(1)).orderBy(part)
    offsets = counts.select(
        *groups,
        part,
        F.coalesce(
            F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(whole).alias(size),
    )
    if not groups:
        offsets = F.broadcast(offsets)  # at most 16**digits rows
    inside = Window.partitionBy(*groups, part).orderBy(digest, *ties)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*groups, part])
        .withColumn(rank, F.col("_before") + F.col("_inside"))
        .drop(part, "_inside", "_before")
    )


#: Keys that are handed to every task, at most.
_TOLD_KEYS = 1 << 18


def mark_alone(rows: DataFrame, key: str, alone: str = "_alone") -> DataFrame:
    """Add ``alone``: whether no other row has the row's key; null is a key like others.

    Only keys are shuffled to tell. Where no key repeats the column is a literal, so that what is left for the others goes
    from the plan; many repeated keys are joined.
    """
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_again"))
    n = repeated.count()
    if not n:
        return rows.withColumn(alone, F.lit(True))
    told = F.broadcast(repeated) if n <= _TOLD_KEYS else repeated
    return rows.join(told, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(alone, F.col("_again").isNull()).drop("_key", "_again")


def order_statistics(
    rows: DataFrame,
    value: str,
    picks: dict[str, Callable[[Column], Column]],
    groups: Sequence[str] = (),
    bins: int = 64,
    counts: dict[str, float] | None = None,
) -> DataFrame:
    """Exact values at chosen zero-based ranks per group.

    ``picks`` maps an output column to the rank as a function of the group size;
    the size ``n`` and the ``mean`` come along. ``counts`` names values whose rows
    are counted in the same pass.
    Equal values are counted first.  Cut points from a mergeable quantile sketch
    then split each group's distinct values into ``bins`` ranges; counts tell
    which ranges hold a wanted rank, and only those are ordered. The sketch's points depend on the order in which its
    parts arrive, so the ranges are kept by a checkpoint: counts and ranks are read from the same ones.
    """
    keys = list(groups) or ["_all"]
    base = rows if groups else rows.withColumn("_all", F.lit(1))
    histogram = (
        base.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    shares = [i / bins for i in range(1, bins)]
    cuts = histogram.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, bins * 100).alias("_cuts"),
        F.sum("_n").alias("n"),
        F.sum(F.col("_v").cast("double") * F.col("_n")).alias("_total"),
        *[F.sum(F.when(F.col("_v") == v, F.col("_n")).otherwise(0)).alias(c) for c, v in (counts or {}).items()],
    )
    if not groups:
        cuts = F.broadcast(cuts)  # one row
    binned = checkpointed(histogram.join(cuts, keys).select(
        *keys, "_v", "_n", "n", "_total", *(counts or {}),
        F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_bin"),
    ))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_rows"), F.first("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("at"))
        for name, rank in picks.items()
    ])
    targets = (
        per_bin.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*keys, "_bin", "_before", "_rows", F.explode(wanted).alias("_pick"))
        .where(F.col("_pick.at").between(F.col("_before"), F.col("_before") + F.col("_rows") - 1))
        .groupBy(*keys, "_bin")
        .agg(F.collect_list(F.struct("_pick.name", (F.col("_pick.at") - F.col("_before")).alias("at"))).alias("_picks"))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        binned.join(targets, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(inside))
        .withColumn("_pick", F.explode("_picks"))
        .where(
            (F.col("_pick.at") < F.col("_upto"))
            & (F.col("_pick.at") >= F.col("_upto") - F.col("_n"))
        )
    )
    out = found.groupBy(*keys, "n", *(counts or {}), (F.col("_total") / F.col("n")).alias("mean")).agg(
        *[F.max(F.when(F.col("_pick.name") == name, F.col("_v"))).alias(name) for name in picks]
    )
    return out if groups else out.drop("_all")


def five_numbers(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """min, p25, median, p75, max and mean with the report's own quartile ranks."""
    picks = {
        "min": lambda n: F.lit(0),
        "p25": lambda n: F.greatest(F.lit(0), F.floor(n * 0.25) - 1),
        "_low": lambda n: F.floor((n - 1) / 2),
        "_high": lambda n: F.floor(n / 2),
        "p75": lambda n: F.least(n - 1, F.floor(n * 0.75)),
        "max": lambda n: n - 1,
    }
    return order_statistics(rows, value, picks, groups).select(
        *groups,
        "n",
        *[F.col(c).cast("double").alias(c) for c in ("min", "p25")],
        ((F.col("_low").cast("double") + F.col("_high").cast("double")) / 2).alias("median"),
        *[F.col(c).cast("double").alias(c) for c in ("p75", "max")],
        "mean",
    )


def linear_percentiles(
    rows: DataFrame, value: str, shares: dict[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Percentiles with linear interpolation between the two neighbouring order statistics."""
    picks = {}
    for name, share in shares.items():
        picks[f"_lo_{name}"] = lambda n, s=share: F.floor((n - 1) * s)
        picks[f"_hi_{name}"] = lambda n, s=share: F.ceil((n - 1) * s)
    ranks = order_statistics(rows, value, picks, groups)

    def blend(name: str, share: float) -> Column:
        at = (F.col("n") - 1) * share
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return ranks.select(*groups, "n", "mean", *[blend(n, s) for n, s in shares.items()])


def top_k(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the rank filter prunes each task before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``: an aggregate with map-side combine, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def distinct_in_order(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct non-blank keys with the position at which each was first seen."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(position).alias(position))


#: Parts that a code's rows are dealt to where they meet that code's one row.
CODE_PARTS = 16


def meet_per_code(rows: DataFrame, per_code: DataFrame, code: str, spread_by: list[str], how: str) -> DataFrame:
    """Join ``rows`` with a table of one row per code, which is repeated for ``CODE_PARTS`` parts of each code.

    ``spread_by`` says which part a row is in, so one large code is several tasks.
    """
    part = F.pmod(F.xxhash64(*spread_by), F.lit(CODE_PARTS)).cast("int")
    repeated = per_code.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(CODE_PARTS - 1))))
    return rows.withColumn("_part", part).join(repeated, [code, "_part"], how).drop("_part")
