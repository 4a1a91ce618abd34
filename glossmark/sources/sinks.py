"""Writers: every sink is a plain Spark write and can be repeated safely."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from glossmark.operators.ordering import first_per_key


def config_name(types: list[str]) -> str:
    """Lower-case types joined by '-'."""
    return "-".join(t.lower() for t in types)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_examples(sentences: DataFrame, path: str) -> None:
    """Parquet partitioned by config and split, so readers prune both."""
    sentences.write.mode("overwrite").partitionBy("config", "split").parquet(path)


def append_new(rows: DataFrame, key: str, path: str, order: list[str] | None = None) -> None:
    """Append one row of each key that the target does not hold yet: a repeated run adds nothing.

    Of a batch's rows with one key the first by ``order`` is kept (all columns by default).
    """
    batch = first_per_key(rows, [key], order or rows.columns)
    try:
        done = rows.sparkSession.read.parquet(path).select(key).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        batch.write.parquet(path)
        return
    batch.join(done, key, "left_anti").write.mode("append").parquet(path)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, which JSON can carry."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(F.isnan(value) | infinite, None).otherwise(value)


def finite_deep(value: Column, kind: DataType) -> Column:
    """``finite`` for doubles at any depth of arrays, maps and structs."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: finite_deep(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: finite_deep(x, kind.valueType))
    if isinstance(kind, StructType):
        cells = [finite_deep(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*cells))
    return value


def report_json(rows: DataFrame) -> DataFrame:
    """One JSON text per report row, non-finite doubles as null."""
    cells = [finite_deep(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    report_json(rows).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document, such as a label mapping, as one text file."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report_index(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the report files present; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split(F.url_decode(F.col("path")), "/"), -1).alias("file_name")).distinct()


def report_manifest(index: DataFrame) -> DataFrame:
    """One row: how many reports, and their names in order."""
    return index.agg(F.count("*").alias("reports"), F.array_sort(F.collect_list("file_name")).alias("file_names"))


def write_documents(documents: DataFrame, root: str) -> None:
    """Raw payload of validated documents, partitioned by code; text and entity views are derived from it."""
    documents.write.mode("overwrite").partitionBy("codigo").parquet(f"{root}/raw")
    raw = documents.sparkSession.read.schema(documents.schema).parquet(f"{root}/raw")
    raw.select("codigo", "codigo_variant", "text").write.mode("overwrite").partitionBy("codigo").parquet(f"{root}/txt")
    raw.drop("text").write.mode("overwrite").partitionBy("codigo").json(f"{root}/entities")


_MANIFEST = "at long, outputs array<struct<name:string,format:string,path:string,rows:long,schema:string>>"


def write_committed(spark: SparkSession, outputs: dict[str, tuple[str, DataFrame | Callable]], root: str) -> None:
    """Write several outputs, name to (format, rows), that become visible together.

    Each goes to a new folder below ``root``; then one manifest row that names the folders and counts their rows is
    appended, and that one-file append is the commit. A run that fails earlier leaves the last committed state as it
    was. Rows are counted while they are written. ``rows`` may be a function: it gets the outputs written
    so far, so what derives from them reads them instead of computing them again.
    """
    folder, done, entries = f"{root}/data/{uuid.uuid4().hex}", {}, []
    for name, (kind, rows) in outputs.items():
        rows, seen = rows(done) if callable(rows) else rows, Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(kind).save(f"{folder}/{name}")
        done[name] = spark.read.schema(rows.schema).format(kind).load(f"{folder}/{name}")
        entries.append((name, kind, f"{folder}/{name}", seen.get["rows"], rows.schema.json()))
    spark.createDataFrame([(time.time_ns(), entries)], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(name, format, path, rows, schema) of each output of the last committed run."""
    runs = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    return runs.agg(F.max_by("outputs", "at").alias("o")).select(F.inline("o"))


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One output of the last committed run."""
    entry = committed(spark, root).where(F.col("name") == name).first()
    if entry is None:
        raise KeyError(f"no committed output {name!r} in {root}")
    return spark.read.schema(StructType.fromJson(json.loads(entry.schema))).format(entry.format).load(entry.path)


def commit_documents(documents: DataFrame, root: str) -> None:
    """Raw payload, texts and entities of validated documents as one committed run; the documents are computed once."""
    write_committed(documents.sparkSession, {
        "raw": ("parquet", documents),
        "txt": ("parquet", lambda done: done["raw"].select("codigo", "codigo_variant", "text")),
        "entities": ("json", lambda done: done["raw"].drop("text")),
    }, root)


def commit_prompts(prompts: DataFrame, root: str) -> None:
    """Prompt rows and the number of prompts of each code as one committed run."""
    write_committed(prompts.sparkSession, {
        "prompts": ("json", prompts),
        "counts": ("parquet", lambda done: done["prompts"].groupBy("codigo").agg(F.count("*").alias("prompts"))),
    }, root)
