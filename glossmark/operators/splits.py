"""Leakage-safe splits, inheritance by derived variants, key repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import clean_code, normalise_code, seeded_hash, variant_key
from glossmark.operators.ordering import rank_by_hash

TRAIN, TEST = "train", "test"


def _check_ratio(train_ratio: float) -> None:
    if not 0 < train_ratio < 1:
        raise ValueError("train_ratio must lie between 0 and 1, both excluded")


def entity_split(rows: DataFrame, key: str, train_ratio: float = 0.7, seed: int = 0) -> DataFrame:
    """(key, split): every key wholly in one split.

    Keys are ordered by a seeded digest; the first half-even rounded share, at
    least one and at most all but one, are train.
    """
    _check_ratio(train_ratio)
    keys = (
        rows.select(clean_code(F.col(key)).alias(key))
        .where(F.col(key).isNotNull())
        .distinct()
        .withColumn("_digest", seeded_hash(seed, F.col(key)))
    )
    ranked = rank_by_hash(keys, "_digest", ties=[key])
    enough = F.when(
        F.col("group_size") < 2,
        F.raise_error(F.lit("an entity split needs at least two distinct keys")).cast("long"),
    ).otherwise(
        F.least(
            F.col("group_size") - 1,
            F.greatest(F.lit(1), F.bround(F.col("group_size") * F.lit(train_ratio))),
        ).cast("long")
    )
    side = F.when(F.col("rank") <= enough, F.lit(TRAIN)).otherwise(F.lit(TEST))
    return ranked.select(key, side.alias("split"))


def row_split(
    rows: DataFrame, key: str, row_id: list[str], train_ratio: float = 0.7, seed: int = 0
) -> DataFrame:
    """Rows with a ``split`` column, stratified inside each key.

    Train takes the floor of the share: at least one row, and never all rows of
    a key that has more than one.
    """
    _check_ratio(train_ratio)
    digested = rows.where(F.col(key).isNotNull()).withColumn(
        "_digest", seeded_hash(seed, *[F.col(c) for c in row_id])
    )
    ranked = rank_by_hash(digested, "_digest", groups=[key], digits=2, ties=row_id)
    share = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(train_ratio)))
    kept = F.when(
        (share == F.col("group_size")) & (F.col("group_size") > 1), share - 1
    ).otherwise(share)
    side = F.when(F.col("rank") <= kept, F.lit(TRAIN)).otherwise(F.lit(TEST))
    return ranked.withColumn("split", side).drop("_digest", "rank", "group_size")


def split_rows(rows: DataFrame, key: str, mode: str = "drug", **options) -> DataFrame:
    """``drug`` keeps keys whole, ``row`` stratifies rows inside a key."""
    if mode == "drug":
        options.pop("row_id", None)
        sides = entity_split(rows, key, **options)
        return rows.withColumn(key, clean_code(F.col(key))).join(sides, key)
    if mode == "row":
        return row_split(rows, key, **options)
    raise ValueError(f"unknown split mode {mode!r}; expected 'drug' or 'row'")


def leaked_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi")


def apply_leak_policy(
    train: DataFrame, test: DataFrame, key: str, policy: str = "raise"
) -> tuple[DataFrame, DataFrame]:
    """``raise`` on any leaked key, ``warn`` keeps both sides, ``drop`` removes it from test only."""
    leaked = leaked_keys(train, test, key)
    if policy == "drop":
        return train, test.join(train.select(key).distinct(), key, "left_anti")
    if policy not in ("raise", "warn"):
        raise ValueError("policy must be 'raise', 'warn' or 'drop'")
    shown = [row[0] for row in leaked.orderBy(key).limit(10).collect()]
    if shown and policy == "raise":
        raise ValueError(f"keys in both splits, first ones: {shown}")
    if shown:
        print(f"warning: keys in both splits, first ones: {shown}")
    return train, test


def inherit_split(derived: DataFrame, parent: str, sides: DataFrame, key: str) -> DataFrame:
    """Derived rows take their parent's split; a parent in both yields rows in both."""
    clean = sides.select(normalise_code(F.col(key)).alias(parent), "split").distinct()
    return derived.withColumn(parent, normalise_code(F.col(parent))).join(clean, parent)


def repair_aliases(codes: DataFrame, key: str, present: DataFrame, present_key: str) -> DataFrame:
    """Add ``resolved``: the zero-stripped code, but only where just that one is present."""
    landed = present.select(F.col(present_key).alias("_p")).distinct()
    bare = F.ltrim(F.col(key), F.lit("0"))
    with_own = codes.join(
        landed.select(F.col("_p").alias(key), F.lit(True).alias("_own")), key, "left"
    ).withColumn("_bare", bare)
    both = with_own.join(
        landed.select(F.col("_p").alias("_bare"), F.lit(True).alias("_stripped")), "_bare", "left"
    )
    use_bare = F.col("_own").isNull() & F.col("_stripped") & (F.col("_bare") != F.col(key))
    return both.withColumn(
        "resolved", F.when(use_bare, F.col("_bare")).otherwise(F.col(key))
    ).drop("_own", "_bare", "_stripped")


def match_variants(expected: DataFrame, key: str, found: DataFrame, found_key: str) -> DataFrame:
    """Found codes with the expected code of the same zero-free key, else their own."""
    wanted = expected.groupBy(variant_key(F.col(key)).alias("_vk")).agg(F.max(key).alias("_code"))
    return (
        found.withColumn("_vk", variant_key(F.col(found_key)))
        .join(wanted, "_vk", "left")
        .withColumn("target", F.coalesce("_code", found_key))
        .drop("_vk", "_code")
    )


def pending(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without an output yet: what a resumed run still has to do."""
    return keys.join(done.select(key).distinct(), key, "left_anti")


def require_complete(expected: DataFrame, actual: DataFrame, key: str) -> None:
    """Raise and name the first missing keys when an export is incomplete."""
    missing = [r[0] for r in pending(expected, actual, key).select(key).distinct().orderBy(key).limit(10).collect()]
    if missing:
        raise RuntimeError(f"missing outputs, first ones: {missing}")


def drop_empty_sentences(
    sentences: DataFrame, labels: str, probability: float, seed: int, row_id: list[str]
) -> DataFrame:
    """Drop a share of the sentences whose labels are all 'O'."""
    from glossmark.functions.keys import below

    if not 0.0 <= probability < 1.0:
        raise ValueError("probability must lie in [0, 1)")
    tagged = F.exists(labels, lambda x: x != "O")
    lucky = ~below(seeded_hash(seed, *[F.col(c) for c in row_id]), probability)
    return sentences.where(tagged | lucky)
