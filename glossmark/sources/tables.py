"""Annotation tables, texts and JSON folders as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark import schemas
from glossmark.functions.text import ws_trim

# Cell texts that mean "missing".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Accepted names of each annotation column.
COLUMN_ALIASES = {
    "codigo": ("CODIGO", "codigo"),
    "medicamento": ("MEDICAMENTO", "medicamento"),
    "reacadv": ("REACADV", "reaccion_adversa", "reacadv"),
    "pactivo": ("PACTIVO", "principio_activo", "pactivo"),
    "frecuencia": ("FRECUENCIA", "frecuencia"),
    "sistema": ("SISTEMA", "sistema"),
}


def resolve_column(columns: Sequence[str], candidates: Iterable[str]) -> str:
    """First candidate that is present, by exact name."""
    names = list(candidates)
    for name in names:
        if name in columns:
            return name
    raise KeyError(f"none of {names} found; have {list(columns)}")


def code_column(columns: Sequence[str]) -> str:
    """The column called 'codigo' in any case, else the first one."""
    return next((c for c in columns if c.lower() == "codigo"), columns[0])


def trim_headers(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.strip() for c in rows.columns])


def require_columns(rows: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise with the sorted missing names, or hand the rows back."""
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return rows


def missing_to_null(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cells that read as missing become NULL."""
    wanted = set(columns)
    return rows.select(*[
        F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) if c in wanted else F.col(c)
        for c in rows.columns
    ])


def read_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV annotations with canonical lower-case columns, all strings, code trimmed."""
    return parse_annotations(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def parse_annotations(rows: DataFrame) -> DataFrame:
    """Annotation cells as read, to canonical columns; see ``read_annotations``."""
    raw = trim_headers(rows)
    picked = raw.select(*[
        F.col(f"`{resolve_column(raw.columns, names)}`").cast("string").alias(name)
        for name, names in COLUMN_ALIASES.items()
        if any(n in raw.columns for n in names)
    ])
    require_columns(picked, schemas.ANNOTATION_COLUMNS)
    clean = missing_to_null(picked, schemas.ANNOTATION_COLUMNS)
    return clean.withColumn("codigo", ws_trim(F.col("codigo")))


def read_synth_annotations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Consolidated annotations: both codes trimmed strings."""
    return parse_synth_annotations(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def parse_synth_annotations(rows: DataFrame) -> DataFrame:
    """Consolidated cells as read, to canonical columns; see ``read_synth_annotations``."""
    raw = trim_headers(rows)
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    names = [*schemas.ANNOTATION_COLUMNS, *schemas.CANONICAL_COLUMNS, "orig_codigo", "variante"]
    require_columns(lower, names)
    return missing_to_null(lower.select(*names), names).select(
        ws_trim(F.col("codigo")).alias("codigo"),
        *[c for c in names if c not in ("codigo", "orig_codigo", "variante")],
        ws_trim(F.col("orig_codigo")).alias("orig_codigo"),
        F.col("variante").cast("int").alias("variante"),
    )


def file_stem(suffix: str) -> Column:
    """File name without folder and suffix."""
    return F.regexp_extract("_metadata.file_name", rf"^(.*){suffix.replace('.', '[.]')}$", 1)


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(codigo, text): one row per file, keyed by its stem."""
    return (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
        .select(file_stem(suffix).alias("codigo"), F.col("value").alias("text"))
    )


def read_lines(spark: SparkSession, folder: str, excluded: DataFrame | None = None, suffix: str = ".txt") -> DataFrame:
    """(codigo, text): one row per line; files named in ``excluded`` (codigo) are left out."""
    rows = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .text(folder)
        .select(file_stem(suffix).alias("codigo"), F.col("value").alias("text"))
    )
    return rows if excluded is None else rows.join(excluded.select("codigo").distinct(), "codigo", "left_anti")


def attach_texts(codes: DataFrame, texts: DataFrame, key: str = "codigo") -> tuple[DataFrame, DataFrame]:
    """Codes with their text, and the codes without one."""
    return codes.join(texts, key), codes.select(key).distinct().join(texts, key, "left_anti")


def read_entity_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): entity files by declared schema; unparseable ones are set apart, not fatal."""
    return parse_entity_files(
        spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value"))


def parse_entity_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_entity_files`` of (file_name, value)."""
    corrupt = "_corrupt_record"
    parsed = F.from_json(
        "value", f"{schemas.ENTITY_FILE}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt}
    )
    rows = files.select("file_name", parsed.alias("p")).select("p.*", "file_name")
    bad = rows.where(F.col(corrupt).isNotNull()).select("file_name", corrupt)
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), bad


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(model, strategy, codigo, pos, pactivo, reacadv, frecuencia, sistema) from model/strategy/code.json."""
    files = (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_predictions(files)


def parse_predictions(files: DataFrame) -> DataFrame:
    """``read_predictions`` of (path, value); the path is url-encoded."""
    part = F.split(F.url_decode(F.col("path")), "/")
    items = F.from_json("value", schemas.PREDICTION)
    return files.select(
        F.element_at(part, -3).alias("model"),
        F.element_at(part, -2).alias("strategy"),
        F.regexp_replace(F.element_at(part, -1), r"[.]json$", "").alias("codigo"),
        F.posexplode(items).alias("pos", "item"),
    ).select(
        "model", "strategy", "codigo", "pos",
        F.col("item")["principio activo"].alias("pactivo"),
        F.col("item")["reacción adversa"].alias("reacadv"),
        F.col("item")["frecuencia"].alias("frecuencia"),
        F.col("item")["trastorno"].alias("sistema"),
    )


def read_registry(spark: SparkSession, drugs: str, sections: str) -> DataFrame:
    """Drug records joined with their section arrays on the register number."""
    records = spark.read.schema(schemas.DRUG_RECORD).option("multiLine", True).json(drugs)
    raw = spark.read.option("pathGlobFilter", "*.json").text(sections, wholetext=True)
    arrays = raw.where(F.startswith(F.ltrim("value"), F.lit("["))).select(
        file_stem(".json").alias("nregistro"),
        F.from_json("value", f"array<struct<{_struct_fields(schemas.SECTION)}>>").alias("secciones"),
    )
    return records.join(arrays, "nregistro")


def _struct_fields(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (field.strip().split(" ") for field in ddl.split(",")))


def with_section(drugs: DataFrame, number: str) -> DataFrame:
    """Drugs that have the section, with the content of the first such one."""
    hits = F.filter("secciones", lambda s: s["seccion"] == number)
    return drugs.withColumn("_s", F.get(hits, F.lit(0))).where(
        F.col("_s").isNotNull() & F.col("_s.contenido").isNotNull()
    ).withColumn("contenido", F.col("_s.contenido")).drop("_s")


def page_requests(total: Column, size: int) -> Column:
    """Page numbers that cover ``total`` rows, last partial page included."""
    pages = F.ceil(total / F.lit(size)).cast("int")
    return F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.expr("cast(array() as array<int>)"))


def distinct_codes(frames: list[DataFrame], column: str = "codigo", position: str | None = None) -> DataFrame:
    """(codigo, first_frame): non-blank codes of several tables, each with the first table that has it.

    ``position`` names a column that orders the rows of a table; ``first_position`` is then the code's first one in its
    first table, so that (first_frame, first_position) is the order of first sight.
    """
    from functools import reduce

    parts = [
        f.select(ws_trim(F.col(column)).alias("codigo"), F.lit(i).alias("first_frame"), *([F.col(position).alias("first_position")] if position else []))
        for i, f in enumerate(frames)
    ]
    rows = reduce(DataFrame.unionByName, parts)
    known = rows.where(F.col("codigo") != "").groupBy("codigo")
    if position is None:
        return known.agg(F.min("first_frame").alias("first_frame"))
    return known.agg(F.min(F.struct("first_frame", "first_position")).alias("_first")).select("codigo", "_first.*")
