"""Entity lists of derived documents to annotation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.labels import ENTITY_COLUMNS, bind
from glossmark.functions.text import ws_trim
from glossmark.operators.ordering import first_per_key, meet_per_code

AUXILIARY = ("ACTIVE", "FREQ", "SYS")


def first_medicine(annotations: DataFrame, order: list[str]) -> DataFrame:
    """(codigo, medicamento): the first non-null name of each code."""
    named = annotations.where(F.col("medicamento").isNotNull()).select(
        ws_trim(F.col("codigo")).alias("codigo"), "medicamento", *order
    )
    return first_per_key(named, ["codigo"], order).select("codigo", "medicamento")


def _clean(entities: str) -> Column:
    shaped = F.transform(
        entities,
        lambda e: F.struct(
            F.upper(ws_trim(F.coalesce(e["type"], F.lit("")))).alias("type"),
            ws_trim(F.coalesce(e["surface"], F.lit(""))).alias("surface"),
            ws_trim(F.coalesce(e["canonical"], F.lit(""))).alias("_canonical"),
        ),
    )
    named = F.transform(
        shaped,
        lambda e: F.struct(
            e["type"].alias("type"),
            F.coalesce(F.nullif(e["_canonical"], F.lit("")), e["surface"]).alias("canonical"),
            e["surface"].alias("surface"),
        ),
    )
    return F.filter(named, lambda e: e["type"].isin(*ENTITY_COLUMNS) & (e["surface"] != ""))


def _of_type(entities: Column, wanted: Column) -> Column:
    return F.filter(entities, lambda e: e["type"] == wanted)


def consolidate(documents: DataFrame, medicines: DataFrame, stamp_first: bool = True) -> DataFrame:
    """Annotation rows with surface and canonical columns, one document at a time.

    Each REACT entity (or, without any, each entity of the first auxiliary type
    present) gives a row; with ``stamp_first`` it carries the document's first
    auxiliary values. Every distinct auxiliary surface adds a row of its own.
    ``documents``: codigo, codigo_variant, variante, medicamento, entities.
    """
    base = (
        meet_per_code(
            documents.where(F.coalesce(F.col("codigo_variant"), F.lit("")) != ""),
            medicines.withColumnRenamed("medicamento", "_known"), "codigo", ["codigo_variant", "variante"], "left")
        .select(
            ws_trim(F.col("codigo")).alias("orig_codigo"),
            ws_trim(F.col("codigo_variant")).alias("codigo"),
            "variante",
            F.coalesce(
                F.nullif(F.col("medicamento"), F.lit("")), F.nullif(F.col("_known"), F.lit("")), F.lit("")
            ).alias("medicamento"),
            _clean("entities").alias("_all"),
        )
    )
    for t in ENTITY_COLUMNS:
        base = base.withColumn(f"_{t}", _of_type(F.col("_all"), F.lit(t)))
    anchor = F.coalesce(*[F.when(F.size(f"_{t}") > 0, F.lit(t)) for t in ENTITY_COLUMNS])
    base = base.withColumn("_anchor", anchor).where(F.col("_anchor").isNotNull())

    def first_of(t: str, field: str) -> Column:
        value = F.get(F.col(f"_{t}"), F.lit(0))[field] if stamp_first else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(""))

    def cells(e: Column, source: Column, stamped: bool) -> list[Column]:
        out = []
        for t, column in ENTITY_COLUMNS.items():
            for field, name in (("surface", column), ("canonical", f"{column}_canonical")):
                other = first_of(t, field) if stamped and t in AUXILIARY else F.lit("")
                out.append(F.when(source == t, e[field]).otherwise(other).alias(name))
        return out

    anchored = F.transform(
        _of_type(F.col("_all"), F.col("_anchor")),
        lambda e: F.struct(*cells(e, F.col("_anchor"), True)),
    )

    def auxiliary_rows(t: str) -> Column:
        # in the order of surfaces, an item is a first one if its neighbour has another surface
        placed = F.array_sort(F.transform(f"_{t}", lambda e, i: F.struct(e["surface"].alias("surface"), i.alias("i"), e.alias("e"))))
        firsts = bind(placed, lambda p: F.filter(p, lambda x, k: (k == 0) | (F.get(p, k - 1)["surface"] != x["surface"])))
        return F.transform(firsts, lambda x: F.struct(*cells(x["e"], F.lit(t), False)))

    extra = [auxiliary_rows(t) for t in AUXILIARY]
    return base.select(
        "codigo", "medicamento", "orig_codigo", "variante", F.explode(F.concat(anchored, *extra)).alias("r")
    ).select("codigo", "medicamento", "r.*", "orig_codigo", "variante")
