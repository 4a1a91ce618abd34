"""What the operators share: word rules, digests, the shared scratch folder, frequent words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: U+0020 and U+0009 to U+000D. Words are the runs between.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no other column's name can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of that struct, some with another value."""
    return [changed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns]


def whole(text: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    """The number of words, without building them: white space runs of a text that ends in one."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by`` (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session without it gets one of its own."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="glossmark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared scratch folder and read again.

    This cuts the lineage and survives lost executors; the cluster's own rule for that folder removes it.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_and_seen(df: DataFrame, *seen: Column) -> tuple[DataFrame, tuple]:
    """``saved``, and aggregates over its rows that are taken while they are written: no job of their own."""
    watch = Observation()
    named = [c.alias(f"seen{i}") for i, c in enumerate(seen)]
    out = saved(df.observe(watch, *named))
    return out, tuple(watch.get[f"seen{i}"] for i in range(len(seen)))


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end, for steps whose rows are written and never run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand Python at most ``rows`` rows in one Arrow batch, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frequency_floor(counts: DataFrame, n: str, most: int) -> int:
    """The smallest count c such that at most ``most`` rows have a count of c or more.

    Reads one histogram over binary orders cut in 16 (under 1,100 rows), so the floor can be a little
    higher than needed; never lower.
    """
    steps = 16
    part = F.floor(F.log2(F.col(n).cast("double")) * steps).cast("int").alias("part")
    rows = counts.groupBy(part).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect()
    total, floor = 0, None
    for row in sorted(rows, key=lambda r: -r["part"]):
        total += row["rows"]
        if total > most:
            break
        floor = row["least"]
    return floor if floor is not None else max((r["least"] for r in rows), default=0) * 2 + 2**62 * (not rows)
