"""Small numeric expressions: scores, ratios, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part/whole as double, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def f1_score(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, F.lit(2.0) * precision * recall / total).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def discard_ratio(matched: Column, declared: Column) -> Column:
    """Share of declared entities that were not found; nothing declared discards nothing."""
    return F.when(declared == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - matched.cast("double") / declared.cast("double")
    )


def warmup_steps(examples: Column, batch: int, epochs: int, share: float) -> Column:
    steps = F.ceil(examples / F.lit(batch)) * F.lit(epochs)
    return F.ceil(steps * F.lit(share)).cast("long")


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k_hit(values: Column, index: Column, k: int) -> Column:
    """True when fewer than ``k`` scores beat the one at ``index``."""
    own = F.get(values, index)
    return F.size(F.filter(values, lambda v: v > own)) < k
