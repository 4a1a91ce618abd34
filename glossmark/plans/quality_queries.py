"""Registered queries: corpus quality report, splits, leakage, key repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmark.operators import assembly, ordering, quality, splits
from glossmark.plans.inputs import (
    SQL_ANNOTATIONS, SQL_SYNTH, SQL_SYNTH_ABSENT, SQL_WORDS, annotations, documents, hashed_sentences, sql_round, synth, table, with_ctes,
)
from glossmark.plans.text_queries import _SQL_WORD_COUNT
from glossmark.sources.tables import distinct_codes, page_requests, parse_annotations, parse_entity_files, parse_predictions

_BOTH = with_ctes(SQL_ANNOTATIONS, SQL_SYNTH)
_SOME = with_ctes(SQL_ANNOTATIONS, SQL_SYNTH_ABSENT)


def _q_coverage(spark, sf):
    return quality.coverage(annotations(spark, sf), synth(spark, sf, absent=True))


_SQL_COVERAGE = _SOME + f"""SELECT r AS real_codes, o AS attempted_codes, v AS synth_documents, {sql_round('100.0::DOUBLE * o / greatest(1, r)', 2)} AS attempted_pct
FROM (SELECT (SELECT count(DISTINCT codigo) FROM ann) AS r, (SELECT count(DISTINCT orig_codigo) FROM synth) AS o, (SELECT count(DISTINCT codigo) FROM synth) AS v)"""


def _recovery(spark, sf):
    return quality.tuple_recovery(annotations(spark, sf), synth(spark, sf, absent=True))


_NORM = "lower(trim(coalesce({c}, '')))"
_RECOVERY = _SOME.rstrip() + f""",
rt AS (SELECT DISTINCT codigo, {_NORM.format(c='reacadv')} AS r, {_NORM.format(c='frecuencia')} AS f, {_NORM.format(c='sistema')} AS s FROM ann),
st AS (SELECT DISTINCT orig_codigo AS codigo, {_NORM.format(c='reacadv_canonical')} AS r, {_NORM.format(c='frecuencia_canonical')} AS f, {_NORM.format(c='sistema_canonical')} AS s FROM synth),
rec AS (SELECT codigo, count(*) AS real_tuples, count(st.r) AS recovered, count(st.r)::DOUBLE / count(*)::DOUBLE AS ratio
  FROM rt LEFT JOIN st USING (codigo, r, f, s) WHERE rt.r <> '' AND rt.f <> '' AND rt.s <> '' AND codigo IN (SELECT orig_codigo FROM synth) GROUP BY codigo)
"""


def _q_recovery(spark, sf):
    return _recovery(spark, sf)


def _q_recovery_summary(spark, sf):
    return quality.tuple_recovery_summary(_recovery(spark, sf))


def _q_worst_best(spark, sf):
    return quality.worst_and_best(_recovery(spark, sf))


def _q_hallucination_rate(spark, sf):
    return quality.hallucination_rate(annotations(spark, sf), synth(spark, sf))


def _q_hallucination_examples(spark, sf):
    return quality.hallucination_examples(annotations(spark, sf), synth(spark, sf))


_CELLS = """cells AS (SELECT lower(orig_codigo) AS codigo, unnest([{'type': 'REACT', 'value': reacadv_canonical}, {'type': 'ACTIVE', 'value': pactivo_canonical},
    {'type': 'FREQ', 'value': frecuencia_canonical}, {'type': 'SYS', 'value': sistema_canonical}]) AS c FROM synth),
known AS (SELECT lower(codigo) AS codigo, unnest([{'type': 'REACT', 'value': reacadv}, {'type': 'ACTIVE', 'value': pactivo},
    {'type': 'FREQ', 'value': frecuencia}, {'type': 'SYS', 'value': sistema}]) AS c FROM ann),
sc AS (SELECT codigo, c.type AS type, lower(trim(c.value)) AS value FROM cells WHERE c.value IS NOT NULL AND trim(c.value) <> ''),
kc AS (SELECT DISTINCT codigo, c.type AS type, lower(trim(c.value)) AS value FROM known WHERE c.value IS NOT NULL AND trim(c.value) <> ''),
un AS (SELECT sc.*, kc.value IS NULL AS bad FROM sc LEFT JOIN kc USING (codigo, type, value))
"""


def _surfaces(spark, sf):
    return quality.surfaces_per_canonical(synth(spark, sf))


_SURFACES = """sf0 AS (SELECT unnest([{'type': 'REACT', 'c': reacadv_canonical, 's': reacadv}, {'type': 'ACTIVE', 'c': pactivo_canonical, 's': pactivo},
    {'type': 'FREQ', 'c': frecuencia_canonical, 's': frecuencia}, {'type': 'SYS', 'c': sistema_canonical, 's': sistema}]) AS x FROM synth),
surf AS (SELECT x.type AS type, trim(x.c) AS canonical, count(DISTINCT trim(x.s)) AS n_surfaces FROM sf0 WHERE trim(x.c) <> '' AND trim(x.s) <> '' GROUP BY 1, 2)
"""


def _q_surfaces(spark, sf):
    return _surfaces(spark, sf)


def _q_diversity(spark, sf):
    return quality.diversity(_surfaces(spark, sf))


def _q_top_synonyms(spark, sf):
    return quality.top_synonyms(_surfaces(spark, sf))


def _forms(spark, sf):
    return quality.frequency_forms(synth(spark, sf))


_EXPECTED = "CASE canonical " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quality.FREQUENCY_TEXT.items()) + " END"
_FORMS = f"""ff AS (SELECT upper(trim(frecuencia_canonical)) AS canonical, lower(trim(frecuencia)) AS surface, count(*) AS n FROM synth
  WHERE frecuencia IS NOT NULL AND frecuencia_canonical IS NOT NULL GROUP BY 1, 2),
fe AS (SELECT *, {_EXPECTED} AS expected FROM ff),
forms AS (SELECT *, coalesce(surface = expected OR surface = rtrim(expected, 's') OR starts_with(expected, surface), false) AS conformant FROM fe)
"""


def _q_forms(spark, sf):
    return _forms(spark, sf)


def _q_conformance(spark, sf):
    return quality.frequency_conformance(_forms(spark, sf))


def _q_deviations(spark, sf):
    return quality.top_deviations(_forms(spark, sf))


def _q_top_surfaces(spark, sf):
    return quality.top_surfaces(_forms(spark, sf))


def _q_lengths_by_source(spark, sf):
    out = quality.lengths(documents(spark, sf, "source"), "text", ["source"])
    return out.select("source", "measure", "n", "min", "p25", "median", "p75", "max")


_SQL_LENGTHS = with_ctes(
    f"""m AS (SELECT source, 'words' AS measure, {_SQL_WORD_COUNT.format(t='text')} AS v FROM documents
  UNION ALL SELECT source, 'chars', length(text) FROM documents)""",
    "r AS (SELECT source, measure, v, row_number() OVER (PARTITION BY source, measure ORDER BY v) - 1 AS k, "
    "count(*) OVER (PARTITION BY source, measure) AS n FROM m)",
) + """SELECT source, measure, n, min(v)::DOUBLE AS min, (max(v) FILTER (WHERE k = greatest(0, CAST(floor(n * 0.25) AS BIGINT) - 1)))::DOUBLE AS p25,
  (max(v) FILTER (WHERE k = (n - 1) // 2) + max(v) FILTER (WHERE k = n // 2)) / 2.0 AS median,
  (max(v) FILTER (WHERE k = least(n - 1, CAST(floor(n * 0.75) AS BIGINT))))::DOUBLE AS p75, max(v)::DOUBLE AS max FROM r GROUP BY source, measure, n"""


def _q_histogram(spark, sf):
    """Field histograms of the labelled documents; unlabelled ones have no such fields."""
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.outcome_histogram(docs, ["lang", "quality", "toxic"])


def _q_documents_summary(spark, sf):
    return quality.documents_summary(documents(spark, sf, "source"), "text", "source", table(spark, sf, "labels"))


def _parent_splits(spark, sf):
    codes = annotations(spark, sf)
    sides = splits.entity_split(codes, "codigo", 0.7, 11)
    return splits.inherit_split(synth(spark, sf), "orig_codigo", sides, "codigo")


def _q_split_report(spark, sf):
    rows = _parent_splits(spark, sf)
    return quality.split_report(rows.where("split = 'train'"), rows.where("split = 'test'"), "codigo", "orig_codigo")


_ENTITY = """ek AS (SELECT DISTINCT codigo, md5('11|' || codigo) AS d FROM ann),
es AS (SELECT codigo, CASE WHEN row_number() OVER (ORDER BY d, codigo) <= least(n - 1, greatest(1, CAST(round_even(CAST(n * 0.7 AS DECIMAL(20,4)), 0) AS BIGINT)))
    THEN 'train' ELSE 'test' END AS split FROM ek, (SELECT count(*) AS n FROM ek))"""


def _q_entity_split(spark, sf):
    return splits.entity_split(table(spark, sf, "orders"), "o_custkey", 0.7, 42)


_SQL_ENTITY = """WITH k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders),
d AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42|' || o_custkey), o_custkey) AS r, count(*) OVER () AS n FROM k)
SELECT o_custkey, CASE WHEN r <= least(n - 1, greatest(1, CAST(round_even(CAST(n * 0.7 AS DECIMAL(20,4)), 0) AS BIGINT))) THEN 'train' ELSE 'test' END AS split FROM d"""


def _q_row_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return splits.row_split(rows, "source", ["doc_id"], 0.9, 5)


_SQL_ROW = """WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
  count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, greatest(1, CAST(floor(n * 0.9) AS BIGINT)) AS t FROM d)
SELECT doc_id, source, CASE WHEN r <= CASE WHEN t = n AND n > 1 THEN t - 1 ELSE t END THEN 'train' ELSE 'test' END AS split FROM s"""


def _q_inherit(spark, sf):
    return _parent_splits(spark, sf).groupBy("codigo", "split").agg(F.count("*").alias("n_rows"))


def _sides(spark, sf):
    """Orders of two overlapping periods: customers of both are the leak."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return orders.where("o_orderpriority < '4'"), orders.where("o_orderpriority >= '4'")


def _q_leaked(spark, sf):
    return splits.leaked_keys(*_sides(spark, sf), "o_custkey")


def _q_leak_dropped(spark, sf):
    train, test = splits.apply_leak_policy(*_sides(spark, sf), "o_custkey", "drop")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_keys"))


def _q_aliases(spark, sf):
    """Zero-padded customer codes against landed files, every third of which lost its zeros."""
    codes = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("codigo"))
    landed = table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string"))
        .otherwise(F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
        .alias("stem")
    )
    return splits.repair_aliases(codes, "codigo", landed, "stem").select("codigo", "resolved")


_SQL_ALIASES = """WITH c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS codigo, ltrim(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0') AS bare FROM customer),
l AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS stem FROM orders)
SELECT codigo, CASE WHEN codigo NOT IN (SELECT stem FROM l) AND bare IN (SELECT stem FROM l) THEN bare ELSE codigo END AS resolved FROM c"""


def _q_variants(spark, sf):
    expected = synth(spark, sf).select("codigo").distinct()
    found = expected.select(F.ltrim(F.col("codigo"), F.lit("0")).alias("stem"))
    return splits.match_variants(expected, "codigo", found, "stem").select("stem", "target")


def _q_pending(spark, sf):
    """Documents a resumed labelling run still has to do."""
    docs = table(spark, sf, "documents").select("doc_id")
    return splits.pending(docs, table(spark, sf, "labels"), "doc_id")


def _q_distinct_codes(spark, sf):
    train = annotations(spark, sf).select("codigo")
    derived = synth(spark, sf).select("codigo")
    return distinct_codes([train, derived])


def _q_first_seen(spark, sf):
    """Codes in the order of first sight: the derived table first, then codes that only the annotations have."""
    keys = [f"l_{c}" for c in ("orderkey", "linenumber", "partkey")]
    sight = F.struct(*keys).alias("at")
    lines = table(spark, sf, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("codigo"), sight, "l_returnflag")
    some = lines.where("l_returnflag = 'R'").withColumn("codigo", F.when(F.col("codigo") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "codigo")))
    seen = distinct_codes([some.drop("l_returnflag"), lines.drop("l_returnflag")], position="at")
    return seen.select("codigo", "first_frame", *[F.col("first_position")[k].alias(k) for k in keys])


def _q_label_ranks(spark, sf):
    """Labels of the sentences by falling count, then by name, per language."""
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    labels = hashed_sentences(spark, sf).select("doc_id", F.explode("gold").alias("label")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    counts = labels.join(lang, "doc_id").groupBy("lang", "label").agg(F.sum("n").alias("n"))
    return quality.ranked_counts(counts, "label", groups=["lang"]).withColumn("rank", F.col("rank").cast("long"))


def _q_parsed_annotations(spark, sf):
    """Annotation cells with padded headers and codes and texts that mean missing, parsed to canonical columns."""
    rows = annotations(spark, sf)
    cells = rows.select(
        F.concat(F.lit(" "), "codigo", F.lit("  ")).alias(" CODIGO"), F.col("medicamento").alias("MEDICAMENTO "), F.col("reacadv").alias("REACADV"),
        F.col("pactivo").alias("PACTIVO"), F.coalesce("frecuencia", F.lit("NA")).alias("FRECUENCIA"),
        F.when(F.substring("h", 1, 1) < "4", "").otherwise(F.col("sistema")).alias(" SISTEMA "), F.lit("x").alias("extra"))
    return parse_annotations(cells).groupBy("codigo", "frecuencia", "sistema").agg(F.count("*").alias("n"), F.countDistinct("reacadv").alias("reactions"))


def _q_entity_files(spark, sf):
    """Entity files made of the documents, a share of them cut short: what is read, and what is set apart."""
    entity = "named_struct('type', upper(lang), 'canonical', source, 'surface', source, 'start', cast(doc_id % 9 as int), 'end', 9)"
    text = F.to_json(F.struct(F.col("source").alias("codigo"), (F.col("doc_id") % 4).cast("int").alias("variante"), (F.col("n_chars") / 1024).alias("discard_ratio"),
        F.expr(f"array_repeat({entity}, cast(doc_id % 5 as int))").alias("entities")))
    files = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.when(F.col("doc_id") % 7 == 0, F.substring(text, 1, 30)).otherwise(text).alias("value"))
    good, bad = parse_entity_files(files)
    return good.select("file_name", "codigo", "variante", "discard_ratio", F.size("entities").cast("long").alias("entities"), F.lit(False).alias("bad")).unionByName(
        bad.select("file_name", F.lit(True).alias("bad")), allowMissingColumns=True)


def _q_prediction_files(spark, sf):
    """Prediction files by path, one of each document: model, strategy and code from the path, rows from the JSON array."""
    item = "named_struct('principio activo', source, 'reacción adversa', lang, 'frecuencia', cast(i as string), 'trastorno', nullif(lang, 'en'))"
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("s3://data/m%20"), "lang", F.lit("/zero-shot/c"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
        F.when(F.col("doc_id") % 6 == 0, "[]").otherwise(F.to_json(F.expr(f"transform(sequence(1, cast(doc_id % 3 + 1 as int)), i -> {item})"))).alias("value"))
    return parse_predictions(files).select("model", "strategy", "codigo", F.col("pos").cast("long"), "pactivo", "reacadv", "frecuencia", "sistema")


def _q_code_selection(spark, sf):
    """Wanted codes in their own order with a flag for unknown ones."""
    wanted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("pos"))
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    chosen, unknown = assembly.select_codes(wanted, known, "k", "pos")
    return chosen.withColumn("unknown", F.lit(False)).unionByName(unknown.withColumn("unknown", F.lit(True)))


def _q_limited_codes(spark, sf):
    """The first ten codes in order of appearance: the run limit."""
    seen = ordering.distinct_in_order(
        table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"), "o_orderkey"), "k", "o_orderkey"
    )
    return seen.orderBy("o_orderkey", "k").limit(10)


def _q_pages(spark, sf):
    totals = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"))
    return totals.select("source", "total", F.explode(page_requests(F.col("total"), 7)).alias("page"))


def _q_config_grid(spark, sf):
    """Every model and strategy for every source; configs are literal arrays."""
    sources = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    models = F.explode(F.array(*map(F.lit, ("model-a", "model-b"))))
    strategies = F.explode(F.array(*map(F.lit, ("zero-shot", "few-shot", "chain-of-thought"))))
    return sources.withColumn("model", models).withColumn("strategy", strategies)


QUERIES = {
    "coverage": _q_coverage,
    "tuple_recovery": _q_recovery,
    "tuple_recovery_summary": _q_recovery_summary,
    "best_worst_codes": _q_worst_best,
    "hallucination_rate": _q_hallucination_rate,
    "hallucination_examples": _q_hallucination_examples,
    "surfaces_per_canonical": _q_surfaces,
    "diversity": _q_diversity,
    "top_synonyms": _q_top_synonyms,
    "frequency_forms": _q_forms,
    "frequency_conformance": _q_conformance,
    "top_deviations": _q_deviations,
    "top_surfaces": _q_top_surfaces,
    "length_section": _q_lengths_by_source,
    "outcome_histogram": _q_histogram,
    "documents_summary": _q_documents_summary,
    "split_report": _q_split_report,
    "entity_split": _q_entity_split,
    "row_split": _q_row_split,
    "inherit_split": _q_inherit,
    "leaked_keys": _q_leaked,
    "leak_dropped": _q_leak_dropped,
    "alias_repair": _q_aliases,
    "variant_match": _q_variants,
    "pending_codes": _q_pending,
    "distinct_codes": _q_distinct_codes,
    "first_seen_codes": _q_first_seen,
    "label_ranks": _q_label_ranks,
    "parsed_annotations": _q_parsed_annotations,
    "entity_files": _q_entity_files,
    "prediction_files": _q_prediction_files,
    "code_selection": _q_code_selection,
    "limited_codes": _q_limited_codes,
    "page_requests": _q_pages,
    "config_grid": _q_config_grid,
}

_INHERITED = _BOTH.rstrip() + ",\n" + _ENTITY + ",\nsr AS (SELECT synth.*, es.split FROM synth JOIN es ON es.codigo = synth.orig_codigo)\n"

ORACLES = {
    "coverage": _SQL_COVERAGE,
    "tuple_recovery": _RECOVERY + "SELECT codigo, real_tuples, recovered, ratio FROM rec",
    "tuple_recovery_summary": _RECOVERY
    + f"""SELECT count(*) AS codes, {sql_round('avg(ratio)', 4)} AS mean_ratio, {sql_round('median(ratio)', 4)} AS median_ratio,
  count(*) FILTER (WHERE ratio = 1) AS perfect, count(*) FILTER (WHERE ratio = 0) AS zero FROM rec""",
    "best_worst_codes": _RECOVERY
    + f"""SELECT side, codigo, real_tuples, recovered, {sql_round('ratio', 4)} AS ratio FROM (
  (SELECT 'worst' AS side, * FROM rec ORDER BY ratio, codigo LIMIT 5) UNION ALL (SELECT 'best', * FROM rec ORDER BY ratio DESC, codigo DESC LIMIT 5))""",
    "hallucination_rate": _BOTH.rstrip() + ",\n" + _CELLS
    + f"""SELECT type, count(*) AS total_mentions, count(*) FILTER (WHERE bad) AS hallucinated,
  {sql_round('100.0::DOUBLE * count(*) FILTER (WHERE bad) / count(*)', 2)} AS rate_pct FROM un GROUP BY type""",
    "hallucination_examples": _BOTH.rstrip() + ",\n" + _CELLS
    + """SELECT codigo, type, value, rank FROM (SELECT codigo, type, value, row_number() OVER (PARTITION BY type ORDER BY value, codigo) AS rank
  FROM (SELECT DISTINCT codigo, type, value FROM un WHERE bad)) WHERE rank <= 10""",
    "surfaces_per_canonical": _BOTH.rstrip() + ",\n" + _SURFACES + "SELECT type, canonical, n_surfaces FROM surf",
    "diversity": _BOTH.rstrip() + ",\n" + _SURFACES
    + f"""SELECT type, count(*) AS canonicals, count(*) FILTER (WHERE n_surfaces > 1) AS with_synonyms,
  {sql_round('100.0::DOUBLE * count(*) FILTER (WHERE n_surfaces > 1) / count(*)', 2)} AS with_synonyms_pct,
  {sql_round('sum(n_surfaces)::DOUBLE / count(*)', 3)} AS mean_surfaces, max(n_surfaces) AS max_surfaces FROM surf GROUP BY type""",
    "top_synonyms": _BOTH.rstrip() + ",\n" + _SURFACES
    + """SELECT type, canonical, n_surfaces, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n_surfaces DESC, canonical) AS rank FROM surf) WHERE rank <= 10""",
    "frequency_forms": _BOTH.rstrip() + ",\n" + _FORMS + "SELECT canonical, surface, n, expected, conformant FROM forms",
    "frequency_conformance": _BOTH.rstrip() + ",\n" + _FORMS
    + f"""SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE conformant) AS BIGINT) AS conformant,
  {sql_round('(sum(n) FILTER (WHERE conformant) * 100)::DOUBLE / sum(n)::DOUBLE', 2)} AS conformant_pct, count(*) FILTER (WHERE NOT conformant) AS deviating_forms FROM forms""",
    "top_deviations": _BOTH.rstrip() + ",\n" + _FORMS
    + "SELECT canonical, surface, n, expected FROM forms WHERE NOT conformant ORDER BY n DESC, canonical, surface LIMIT 15",
    "top_surfaces": _BOTH.rstrip() + ",\n" + _FORMS
    + "SELECT canonical, rank, surface, n FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, surface) AS rank FROM forms) WHERE rank <= 5",
    "length_section": _SQL_LENGTHS,
    "outcome_histogram": """WITH d AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS field, lang AS value, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY 2
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM d WHERE quality IS NOT NULL GROUP BY 2
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM d WHERE toxic IS NOT NULL GROUP BY 2""",
    "documents_summary": f"""SELECT count(*) AS documents, count(DISTINCT source) AS drugs, {sql_round('sum(length(text))::DOUBLE / count(*)', 1)} AS mean_chars,
  {sql_round('sum(' + _SQL_WORD_COUNT.format(t='text') + ')::DOUBLE / count(*)', 1)} AS mean_words, (SELECT count(*) FROM labels) AS entities FROM documents""",
    "split_report": _INHERITED
    + """SELECT count(DISTINCT codigo) FILTER (WHERE split = 'train') AS train_codes, count(DISTINCT codigo) FILTER (WHERE split = 'test') AS test_codes,
  count(DISTINCT orig_codigo) FILTER (WHERE split = 'train') AS train_parents, count(DISTINCT orig_codigo) FILTER (WHERE split = 'test') AS test_parents,
  (SELECT count(*) FROM (SELECT orig_codigo FROM sr GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows FROM sr""",
    "entity_split": _SQL_ENTITY,
    "row_split": _SQL_ROW,
    "inherit_split": _INHERITED + "SELECT codigo, split, count(*) AS n_rows FROM sr GROUP BY 1, 2",
    "leaked_keys": """SELECT o_custkey FROM orders WHERE o_orderpriority < '4' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority >= '4'""",
    "leak_dropped": """WITH a AS (SELECT * FROM orders WHERE o_orderpriority < '4'), b AS (SELECT * FROM orders WHERE o_orderpriority >= '4'
  AND o_custkey NOT IN (SELECT o_custkey FROM a))
SELECT 'train' AS side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM a UNION ALL SELECT 'test', count(*), count(DISTINCT o_custkey) FROM b HAVING count(*) > 0""",
    "alias_repair": _SQL_ALIASES,
    "variant_match": _BOTH + "SELECT DISTINCT ltrim(codigo, '0') AS stem, codigo AS target FROM synth",
    "pending_codes": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "distinct_codes": _BOTH + "SELECT DISTINCT codigo, 0 AS first_frame FROM ann UNION ALL SELECT DISTINCT codigo, 1 FROM synth",
    "first_seen_codes": """WITH l AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS codigo, l_suppkey % 5 AS m, l_returnflag AS f, l_orderkey, l_linenumber, l_partkey FROM lineitem),
x AS (SELECT codigo, 0 AS first_frame, l_orderkey, l_linenumber, l_partkey FROM l WHERE f = 'R' AND m <> 0
  UNION ALL SELECT codigo, 1, l_orderkey, l_linenumber, l_partkey FROM l)
SELECT codigo, first_frame, l_orderkey, l_linenumber, l_partkey FROM x
QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY first_frame, l_orderkey, l_linenumber, l_partkey) = 1""",
    "label_ranks": with_ctes(SQL_WORDS) + """SELECT lang, label, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, label) AS rank
FROM (SELECT lang, gold AS label, count(*) AS n FROM words JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY 1, 2)""",
    "parsed_annotations": with_ctes(SQL_ANNOTATIONS) + """SELECT codigo, frecuencia, CASE WHEN substr(h, 1, 1) >= '4' THEN sistema END AS sistema, count(*) AS n,
  count(DISTINCT reacadv) AS reactions FROM ann GROUP BY 1, 2, 3""",
    "entity_files": """SELECT doc_id || '.json' AS file_name, CASE WHEN doc_id % 7 <> 0 THEN source END AS codigo, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 4 AS INT) END AS variante,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars / 1024.0::DOUBLE END AS discard_ratio, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 END AS entities, doc_id % 7 = 0 AS bad FROM documents""",
    "prediction_files": """SELECT 'm ' || lang AS model, 'zero-shot' AS strategy, 'c' || doc_id AS codigo, i - 1 AS pos, source AS pactivo, lang AS reacadv,
  CAST(i AS VARCHAR) AS frecuencia, nullif(lang, 'en') AS sistema
FROM (SELECT *, unnest(range(1, doc_id % 3 + 2)) AS i FROM documents WHERE doc_id % 6 <> 0)""",
    "code_selection": """SELECT o_custkey AS k, min(o_orderkey) AS pos, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS unknown FROM orders GROUP BY o_custkey""",
    "limited_codes": "SELECT CAST(o_custkey AS VARCHAR) AS k, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
    "page_requests": "WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source) SELECT source, total, unnest(generate_series(1, CAST(ceil(total / 7.0) AS BIGINT))) AS page FROM t",
    "config_grid": """SELECT source, count(*) AS documents, model, strategy FROM documents, (VALUES ('model-a'), ('model-b')) AS m(model),
  (VALUES ('zero-shot'), ('few-shot'), ('chain-of-thought')) AS s(strategy) GROUP BY source, model, strategy""",
}
