"""Corpus quality report: each section is one DataFrame.

``real`` is the annotation table (codigo, reacadv, pactivo, frecuencia, sistema);
``synth`` the consolidated one, with ``<column>_canonical``, orig_codigo, variante.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.labels import ENTITY_COLUMNS
from glossmark.functions.numeric import ratio
from glossmark.functions.text import norm_lower, word_count, ws_trim
from glossmark.operators.ordering import five_numbers, order_statistics, top_k

# Textual form of each frequency category.
FREQUENCY_TEXT = {
    "MUY FRECUENTE": "muy frecuentes",
    "FRECUENTE": "frecuentes",
    "POCO FRECUENTE": "poco frecuentes",
    "RARA": "raras",
    "MUY RARA": "muy raras",
    "FRECUENCIA NO CONOCIDA": "frecuencia no conocida",
    "NO CONOCIDA": "frecuencia no conocida",
    "SIN FRECUENCIA": "frecuencia no conocida",
}
UNKNOWN_FREQUENCY = "frecuencia no conocida"


def _text_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in FREQUENCY_TEXT.items() for x in pair])


def frequency_text(value: Column) -> Column:
    """Textual form of a frequency; unmapped values in lower case, NULL is not known."""
    bare = ws_trim(value)
    return F.coalesce(F.element_at(_text_map(), F.upper(bare)), F.lower(bare), F.lit(UNKNOWN_FREQUENCY))


def coverage(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Distinct real codes, codes attempted, synthetic documents, share attempted."""
    r = real.select(ws_trim(F.col("codigo")).alias("k"), F.lit("real").alias("side")).distinct()
    o = synth.select(ws_trim(F.col("orig_codigo")).alias("k"), F.lit("orig").alias("side")).distinct()
    v = synth.select(ws_trim(F.col("codigo")).alias("k"), F.lit("variant").alias("side")).distinct()

    def count_of(side: str) -> Column:
        return F.count(F.when(F.col("side") == side, 1))

    return r.unionByName(o).unionByName(v).agg(
        count_of("real").alias("real_codes"),
        count_of("orig").alias("attempted_codes"),
        count_of("variant").alias("synth_documents"),
        F.bround(
            F.lit(100.0) * count_of("orig") / F.greatest(F.lit(1), count_of("real")), 2
        ).alias("attempted_pct"),
    )


def tuple_recovery(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Per attempted code: distinct full real tuples, and how many a variant recovered."""
    columns = ["reacadv", "frecuencia", "sistema"]

    def tuples(rows: DataFrame, code: str, suffix: str, flag: str) -> DataFrame:
        cells = rows.select(
            ws_trim(F.col(code)).alias("codigo"),
            *[norm_lower(F.col(c + suffix)).alias(c) for c in columns],
            F.lit(flag).alias("side"),
        )
        return cells.where(" and ".join(f"{c} <> ''" for c in columns)).distinct()

    both = tuples(real, "codigo", "", "real").unionByName(
        tuples(synth, "orig_codigo", "_canonical", "synth")
    )
    merged = both.groupBy("codigo", *columns).agg(
        F.max(F.col("side") == "real").alias("real"), F.max(F.col("side") == "synth").alias("synth")
    )
    attempted = synth.select(ws_trim(F.col("orig_codigo")).alias("codigo")).distinct()
    return (
        merged.where("real")
        .groupBy("codigo")
        .agg(F.count("*").alias("real_tuples"), F.count(F.when(F.col("synth"), 1)).alias("recovered"))
        .join(attempted, "codigo", "left_semi")
        .withColumn("ratio", ratio(F.col("recovered"), F.col("real_tuples")))
    )


def tuple_recovery_summary(per_code: DataFrame) -> DataFrame:
    """One row: codes, mean, median, perfect and zero recoveries."""
    picks = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    return order_statistics(per_code, "ratio", picks, counts={"perfect": 1.0, "zero": 0.0}).select(
        F.col("n").alias("codes"),
        F.bround("mean", 4).alias("mean_ratio"),
        F.bround((F.col("low") + F.col("high")) / 2, 4).alias("median_ratio"),
        "perfect",
        "zero",
    )


def worst_and_best(per_code: DataFrame, k: int = 5) -> DataFrame:
    """First and last ``k`` codes by (ratio, code), with their rank from each end."""
    shown = F.bround("ratio", 4).alias("ratio")
    worst = per_code.orderBy(F.asc("ratio"), F.asc("codigo")).limit(k)
    best = per_code.orderBy(F.desc("ratio"), F.desc("codigo")).limit(k)
    return worst.select(F.lit("worst").alias("side"), "codigo", "real_tuples", "recovered", shown).unionByName(
        best.select(F.lit("best").alias("side"), "codigo", "real_tuples", "recovered", shown)
    )


def canonical_cells(synth: DataFrame) -> DataFrame:
    """Long form: variant code, parent code, type, normalised canonical value; blanks out."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("type"), norm_lower(F.col(f"{c}_canonical")).alias("value"))
        for t, c in ENTITY_COLUMNS.items()
    ])
    return (
        synth.select(F.col("codigo").alias("codigo_variant"), norm_lower(F.col("orig_codigo")).alias("codigo"), F.explode(cells).alias("c"))
        .select("codigo_variant", "codigo", "c.*")
        .where(F.col("value") != "")
    )


def real_cells(real: DataFrame) -> DataFrame:
    """Distinct (code, type, normalised value) of the annotation table."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("type"), norm_lower(F.col(c)).alias("value"))
        for t, c in ENTITY_COLUMNS.items()
    ])
    return (
        real.select(norm_lower(F.col("codigo")).alias("codigo"), F.explode(cells).alias("c"))
        .select("codigo", "c.*")
        .where(F.col("value") != "")
        .distinct()
    )


def hallucination_rate(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Per type: canonical cells, and those whose value the parent code does not have.

    Equal cells are counted before the join, so a hot value is one row.
    """
    counted = canonical_cells(synth).groupBy("codigo", "type", "value").agg(F.count("*").alias("n"))
    known = real_cells(real).withColumn("_known", F.lit(True))
    joined = counted.join(known, ["codigo", "type", "value"], "left")
    total = F.sum("n")
    bad = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0))
    return joined.groupBy("type").agg(
        total.alias("total_mentions"),
        bad.alias("hallucinated"),
        F.bround(F.lit(100.0) * bad / total, 2).alias("rate_pct"),
    )


def hallucination_examples(real: DataFrame, synth: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` distinct unknown values per type, in value order."""
    unknown = (
        canonical_cells(synth).select("codigo", "type", "value").distinct()
        .join(real_cells(real), ["codigo", "type", "value"], "left_anti")
    )
    return top_k(unknown, ["type"], [F.col("value"), F.col("codigo")], k)


def surfaces_per_canonical(synth: DataFrame) -> DataFrame:
    """(type, canonical, n_surfaces): distinct trimmed surfaces of each canonical value."""
    cells = F.array(*[
        F.struct(
            F.lit(t).alias("type"),
            ws_trim(F.col(f"{c}_canonical")).alias("canonical"),
            ws_trim(F.col(c)).alias("surface"),
        )
        for t, c in ENTITY_COLUMNS.items()
    ])
    pairs = (
        synth.select(F.explode(cells).alias("c")).select("c.*")
        .where("canonical <> '' and surface <> ''")
        .distinct()
    )
    return pairs.groupBy("type", "canonical").agg(F.count("*").alias("n_surfaces"))


def diversity(surfaces: DataFrame) -> DataFrame:
    """Per type: canonicals, those with synonyms, mean and maximum surfaces."""
    many = F.count(F.when(F.col("n_surfaces") > 1, 1))
    return surfaces.groupBy("type").agg(
        F.count("*").alias("canonicals"),
        many.alias("with_synonyms"),
        F.bround(F.lit(100.0) * many / F.count("*"), 2).alias("with_synonyms_pct"),
        F.bround(F.sum("n_surfaces") / F.count("*"), 3).alias("mean_surfaces"),
        F.max("n_surfaces").alias("max_surfaces"),
    )


def top_synonyms(surfaces: DataFrame, k: int = 10) -> DataFrame:
    return top_k(surfaces, ["type"], [F.desc("n_surfaces"), F.asc("canonical")], k)


def frequency_forms(synth: DataFrame) -> DataFrame:
    """(canonical, surface, n, expected, conformant) of the frequency column."""
    target = F.lower(F.element_at(_text_map(), F.col("canonical")))
    singular = F.rtrim(target, F.lit("s"))
    fits = (
        (F.col("surface") == target) | (F.col("surface") == singular) | F.startswith(target, F.col("surface"))
    )
    return (
        synth.where(F.col("frecuencia").isNotNull() & F.col("frecuencia_canonical").isNotNull())
        .groupBy(
            F.upper(ws_trim(F.col("frecuencia_canonical"))).alias("canonical"),
            F.lower(ws_trim(F.col("frecuencia"))).alias("surface"),
        )
        .agg(F.count("*").alias("n"))
        .select("canonical", "surface", "n", target.alias("expected"), F.coalesce(fits, F.lit(False)).alias("conformant"))
    )


def frequency_conformance(forms: DataFrame) -> DataFrame:
    """One row: total, conformant rows and share, number of deviating forms."""
    good = F.coalesce(F.sum(F.when(F.col("conformant"), F.col("n"))), F.lit(0))
    return forms.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        good.alias("conformant"),
        F.bround(ratio(good * 100, F.sum("n")), 2).alias("conformant_pct"),
        F.count(F.when(~F.col("conformant"), 1)).alias("deviating_forms"),
    )


def top_deviations(forms: DataFrame, k: int = 15) -> DataFrame:
    return (
        forms.where("not conformant")
        .orderBy(F.desc("n"), F.asc("canonical"), F.asc("surface"))
        .limit(k)
        .select("canonical", "surface", "n", "expected")
    )


def top_surfaces(forms: DataFrame, k: int = 5) -> DataFrame:
    return top_k(forms, ["canonical"], [F.desc("n"), F.asc("surface")], k).select(
        "canonical", "rank", "surface", "n"
    )


def lengths(docs: DataFrame, text: str, groups: list[str]) -> DataFrame:
    """Word and character five-number summaries, one row per group and measure."""
    measures = F.array(
        F.struct(F.lit("words").alias("measure"), word_count(F.col(text)).alias("v")),
        F.struct(F.lit("chars").alias("measure"), F.length(text).alias("v")),
    )
    long = docs.select(*groups, F.explode(measures).alias("m")).select(*groups, "m.*")
    return five_numbers(long, "v", [*groups, "measure"])


def outcome_histogram(documents: DataFrame, columns: list[str]) -> DataFrame:
    """Long histogram (field, value, n) over the named columns; missing fields are left out."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        documents.select(F.explode(cells).alias("c")).select("c.*")
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
    )


def split_report(train: DataFrame, test: DataFrame, code: str, parent: str) -> DataFrame:
    """One row: rows and distinct codes per side, distinct parents per side, parents on both."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(ws_trim(F.col(parent)).alias("p"), F.col(code).alias("c")).agg(
            F.count("*").alias("n")
        ).withColumn("side", F.lit(name))

    codes = side(train, "train").unionByName(side(test, "test"))
    parents = codes.groupBy("p").agg(*[
        F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"{s}_rows") for s in ("train", "test")
    ], *[
        F.countDistinct(F.when(F.col("side") == s, F.col("c"))).alias(f"{s}_codes") for s in ("train", "test")
    ])
    return parents.agg(
        *[F.coalesce(F.sum(f"{s}_codes"), F.lit(0)).alias(f"{s}_codes") for s in ("train", "test")],
        *[F.count(F.when(F.col(f"{s}_rows") > 0, 1)).alias(f"{s}_parents") for s in ("train", "test")],
        F.count(F.when((F.col("train_rows") > 0) & (F.col("test_rows") > 0), 1)).alias("leaked"),
        *[F.coalesce(F.sum(f"{s}_rows"), F.lit(0)).alias(f"{s}_rows") for s in ("train", "test")],
    )


def label_distribution(tokens: DataFrame, label: str = "label", groups: list[str] | None = None) -> DataFrame:
    """Label counts and their percentage per group (3 dp)."""
    from pyspark.sql import Window

    keys = groups or []
    counts = tokens.groupBy(*keys, label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    return counts.withColumn("pct", F.bround(F.lit(100.0) * F.col("n") / F.sum("n").over(whole), 3))


def ranked_counts(counts: DataFrame, value: str, n: str = "n", groups: list[str] | None = None) -> DataFrame:
    """``counts`` with ``rank`` per group: larger counts first, equal ones by value. For the few values of a vocabulary."""
    from pyspark.sql import Window

    order = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(F.desc(n), value)
    return counts.withColumn("rank", F.row_number().over(order))


def corpus_summary(labelled: DataFrame, doc_key: str, groups: list[str] | None = None) -> DataFrame:
    """Documents, sentences, tokens, tagged tokens, their share, documents without a tag."""
    keys = groups or []
    tagged = F.count(F.when(F.col("label") != "O", 1))
    per_doc = labelled.groupBy(*keys, doc_key).agg(
        F.countDistinct("sent_idx").alias("s"), F.count("*").alias("t"), tagged.alias("g")
    )
    return per_doc.groupBy(*keys).agg(
        F.count("*").alias("documents"),
        F.sum("s").alias("sentences"),
        F.sum("t").alias("tokens"),
        F.sum("g").alias("tagged_tokens"),
        F.bround(ratio(F.sum("g"), F.sum("t")), 6).alias("tagged_share"),
        F.count(F.when(F.col("g") == 0, 1)).alias("untagged_documents"),
    )


def documents_summary(docs: DataFrame, text: str, code: str, entities: DataFrame | None = None, doc_key: str = "doc_id") -> DataFrame:
    """Documents, drugs, mean characters and words (1 dp); entity counts come from ``entities``."""
    out = docs.agg(
        F.count("*").alias("documents"),
        F.countDistinct(code).alias("drugs"),
        F.bround(ratio(F.sum(F.length(text)), F.count("*")), 1).alias("mean_chars"),
        F.bround(ratio(F.sum(word_count(F.col(text))), F.count("*")), 1).alias("mean_words"),
    )
    if entities is None:
        return out
    return out.select("*", entities.agg(F.count("*")).scalar().alias("entities"))
