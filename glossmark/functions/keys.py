"""Keys: code normalisers, variant codes, reproducible hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmark.functions.text import ws_trim


def clean_code(code: Column) -> Column:
    """NBSP out and strip; what the entity split applies to its keys."""
    return ws_trim(F.replace(code.cast("string"), F.lit("\u00a0"), F.lit("")))


def normalise_code(code: Column) -> Column:
    """``clean_code`` plus the '.0' that a float round trip leaves behind digits."""
    return F.regexp_replace(clean_code(code), r"^(\d+)\.0$", "$1")


def variant_code(code: Column, variant: Column) -> Column:
    return F.concat(code, F.lit("_v"), variant.cast("string"))


def parent_code(code: Column) -> Column:
    """Part before the last '_v'; the whole code when it has no variant."""
    return F.regexp_replace(code, r"(?s)_v((?!_v).)*$", "")


def _zero_free(value: Column) -> Column:
    bare = F.ltrim(value, F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def variant_key(code: Column) -> Column:
    """Key that ignores leading zeros of the parent: 0012_v2 -> 12_v2, 000 -> 0."""
    bare = ws_trim(code)
    base = parent_code(bare)
    tail = F.substring(bare, F.length(base) + 1, F.length(bare))
    return F.concat(_zero_free(base), tail)


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """md5 over seed and key: the same digest on every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def below(digest: Column, probability: float) -> Column:
    """True for a ``probability`` share of digests: compares the first 32 bits as hex text."""
    edge = round(probability * 2**32)
    if edge >= 2**32:
        return F.lit(True)
    return F.substring(digest, 1, 8) < F.lit(f"{edge:08x}")
