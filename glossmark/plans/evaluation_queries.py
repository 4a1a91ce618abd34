"""Registered queries: gold matching, span schemas, MLM scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmark.functions.labels import label_spans
from glossmark.functions.keys import seeded_hash
from glossmark.operators import evaluation
from glossmark.plans.inputs import (
    ANNOTATION_ORDER, SQL_ANNOTATIONS, SQL_ORDER, SQL_PREDICTIONS, SQL_PREDICTIONS_ABSENT, SQL_WORDS,
    annotations, hashed_sentences, latin_keys, predictions, sql_round, table, with_ctes,
)
from glossmark.plans.tagging_queries import sql_label_spans


def gold_and_predictions(spark, sf, absent=False):
    return latin_keys(annotations(spark, sf)), latin_keys(predictions(spark, sf, absent))


def _scores(spark, sf):
    """Scores with some codes' files missing."""
    return evaluation.code_scores(*gold_and_predictions(spark, sf, absent=True), ANNOTATION_ORDER)


_KEY = "lower(trim(coalesce({c}, 'nan')))"
_SQL_EVAL_ALL = with_ctes(
    SQL_ANNOTATIONS,
    SQL_PREDICTIONS,
    f"""gold AS (SELECT codigo, {_KEY.format(c='pactivo')} AS pk, {_KEY.format(c='reacadv')} AS rk,
    {_KEY.format(c='frecuencia')} AS fk, {_KEY.format(c='sistema')} AS sk FROM ann)""",
    f"""pr AS (SELECT codigo, pactivo, reacadv, frecuencia, sistema, {_KEY.format(c='pactivo')} AS pk, {_KEY.format(c='reacadv')} AS rk,
    {_KEY.format(c='frecuencia')} AS fk, {_KEY.format(c='sistema')} AS sk, {SQL_ORDER},
    row_number() OVER (PARTITION BY codigo, {_KEY.format(c='pactivo')}, {_KEY.format(c='reacadv')} ORDER BY {SQL_ORDER}) AS rn FROM pred)""",
    """hit AS (SELECT g.*, p.codigo IS NOT NULL AS matched,
    coalesce(contains(g.fk, p.fk) OR contains(p.fk, g.fk), false) AS frequency_ok, coalesce(g.sk = p.sk, false) AS system_ok
  FROM gold g LEFT JOIN (SELECT * FROM pr WHERE rn = 1) p USING (codigo, pk, rk))""",
    """inv AS (SELECT p.* FROM pr p WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.codigo = p.codigo AND g.pk = p.pk AND g.rk = p.rk))""",
    """scores AS (SELECT codigo, count(*) AS gold_rows, count(*) FILTER (WHERE matched) AS matched,
    count(*) FILTER (WHERE frequency_ok) AS frequency_ok, count(*) FILTER (WHERE system_ok) AS system_ok FROM hit GROUP BY codigo)""",
    """full_scores AS (SELECT s.*, coalesce(n, 0) AS predicted_rows, coalesce(h, 0) AS hallucinated, n IS NULL AS file_missing FROM scores s
    LEFT JOIN (SELECT codigo, count(*) AS n FROM pred GROUP BY codigo) USING (codigo)
    LEFT JOIN (SELECT codigo, count(*) AS h FROM inv GROUP BY codigo) USING (codigo))""",
)
_SQL_EVAL = _SQL_EVAL_ALL.replace(SQL_PREDICTIONS, SQL_PREDICTIONS_ABSENT)


def _q_match(spark, sf):
    """Matched cells per code and gold key."""
    gold, predicted = gold_and_predictions(spark, sf)
    cells = evaluation.match_gold(gold, predicted, ANNOTATION_ORDER)
    return cells.groupBy("codigo", "pactivo_key", "reacadv_key").agg(
        F.sum("n").alias("gold_rows"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("frequency_ok"), F.col("n"))), F.lit(0)).alias("frequency_ok"),
        F.coalesce(F.sum(F.when(F.col("system_ok"), F.col("n"))), F.lit(0)).alias("system_ok"),
    )


def _q_code_scores(spark, sf):
    return _scores(spark, sf)


def _q_hallucinations(spark, sf):
    gold, predicted = gold_and_predictions(spark, sf)
    return evaluation.hallucinations(gold, predicted, ANNOTATION_ORDER).select(
        "codigo", "pactivo", "reacadv", "frecuencia", "sistema"
    )


def _q_missing_files(spark, sf):
    return _scores(spark, sf).where("file_missing").select("codigo", "gold_rows")


def _q_summary(spark, sf):
    return evaluation.evaluation_summary(_scores(spark, sf))


def _q_tags(spark, sf):
    return evaluation.tag_scores(_scores(spark, sf))


def sql_prf(good: str, actual: str, possible: str) -> str:
    p = f"(CASE WHEN ({actual}) = 0 THEN 0.0::DOUBLE ELSE ({good})::DOUBLE / ({actual})::DOUBLE END)"
    r = f"(CASE WHEN ({possible}) = 0 THEN 0.0::DOUBLE ELSE ({good})::DOUBLE / ({possible})::DOUBLE END)"
    f1 = f"(CASE WHEN {p} + {r} > 0 THEN 2.0::DOUBLE * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END)"
    return f"{sql_round(p, 4)} AS precision, {sql_round(r, 4)} AS recall, {sql_round(f1, 4)} AS f1"


_SQL_TAGS = _SQL_EVAL + f"""SELECT tag, correct, missed, spurious, {sql_prf('correct', 'correct + spurious', 'correct + missed')}
FROM (SELECT coalesce(tag, 'overall') AS tag, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(m) AS BIGINT) AS missed, CAST(sum(s) AS BIGINT) AS spurious FROM (
  SELECT 'REACADV' AS tag, matched AS c, gold_rows - matched AS m, hallucinated AS s FROM full_scores
  UNION ALL SELECT 'FRECUENCIA', frequency_ok, gold_rows - frequency_ok, 0 FROM full_scores
  UNION ALL SELECT 'SISTEMA', system_ok, gold_rows - system_ok, 0 FROM full_scores) GROUP BY GROUPING SETS ((tag), ()))"""


def span_sentences(spark, sf):
    rows = hashed_sentences(spark, sf)
    return rows.select(
        "doc_id", "sent_idx", label_spans(F.col("gold")).alias("gold_spans"), label_spans(F.col("pred")).alias("pred_spans")
    )


_SPAN_CTES = with_ctes(SQL_WORDS, sql_label_spans("gold", "gs"), sql_label_spans("pred", "ps"))


def span_islands(spark, sf):
    return evaluation.overlap_islands(span_sentences(spark, sf), ["doc_id", "sent_idx"], "gold_spans", "pred_spans")


def _q_loose(spark, sf):
    return evaluation.loose_overlap(span_islands(spark, sf), "gold_spans", "pred_spans")


_OVERLAP = 'g.doc_id = p.doc_id AND g.sent_idx = p.sent_idx AND g.tag = p.tag AND g.start < p."end" AND p.start < g."end"'
_SQL_LOOSE = _SPAN_CTES + f""", c AS (SELECT tag, sum(mp) AS matched_pred, sum(mg) AS matched_gold, sum(p) AS pred, sum(g) AS gold FROM (
  SELECT tag, CASE WHEN EXISTS (SELECT 1 FROM gs g WHERE {_OVERLAP}) THEN 1 ELSE 0 END AS mp, 0 AS mg, 1 AS p, 0 AS g FROM ps p
  UNION ALL SELECT tag, 0, CASE WHEN EXISTS (SELECT 1 FROM ps p WHERE {_OVERLAP}) THEN 1 ELSE 0 END, 0, 1 FROM gs g) GROUP BY tag),
d AS (SELECT *, CASE WHEN pred = 0 THEN 0.0::DOUBLE ELSE matched_pred::DOUBLE / pred::DOUBLE END AS p0,
  CASE WHEN gold = 0 THEN 0.0::DOUBLE ELSE matched_gold::DOUBLE / gold::DOUBLE END AS r0 FROM c)
SELECT tag, CAST(matched_pred AS BIGINT) AS matched_pred, CAST(matched_gold AS BIGINT) AS matched_gold, CAST(pred AS BIGINT) AS pred,
  CAST(gold AS BIGINT) AS gold, {sql_round('p0', 4)} AS precision, {sql_round('r0', 4)} AS recall,
  {sql_round('CASE WHEN p0 + r0 > 0 THEN 2.0::DOUBLE * p0 * r0 / (p0 + r0) ELSE 0.0::DOUBLE END', 4)} AS f1 FROM d"""


def _q_averages(spark, sf):
    return evaluation.averaged_scores(evaluation.label_hits(hashed_sentences(spark, sf), "gold", "pred"))


_SQL_AVERAGES = _SPAN_CTES + f""", n AS (SELECT tag, count(*) FILTER (WHERE side = 'g') AS support, count(*) FILTER (WHERE side = 'p') AS predicted,
    count(*) FILTER (WHERE side = 'b') AS correct FROM (
  SELECT tag, 'g' AS side FROM gs UNION ALL SELECT tag, 'p' FROM ps
  UNION ALL SELECT g.tag, 'b' FROM gs g JOIN ps p ON p.doc_id = g.doc_id AND p.sent_idx = g.sent_idx AND p.tag = g.tag AND p.start = g.start AND p."end" = g."end") GROUP BY tag),
q AS (SELECT tag, support, predicted, correct, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / predicted END AS p,
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / support END AS r FROM n),
t AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM q),
m AS (SELECT sum(correct)::DOUBLE / sum(predicted)::DOUBLE AS p, sum(correct)::DOUBLE / sum(support)::DOUBLE AS r, sum(support) AS support FROM t),
o AS (SELECT tag, support, p, r, f FROM t
  UNION ALL SELECT 'micro avg', support, p, r, 2.0::DOUBLE * p * r / (p + r) FROM m
  UNION ALL SELECT 'macro avg', sum(support), avg(p), avg(r), avg(f) FROM t
  UNION ALL SELECT 'weighted avg', sum(support), sum(p * support)::DOUBLE / sum(support)::DOUBLE, sum(r * support)::DOUBLE / sum(support)::DOUBLE,
    sum(f * support)::DOUBLE / sum(support)::DOUBLE FROM t)
SELECT tag, CAST(support AS BIGINT) AS support, {sql_round('p', 4)} AS precision, {sql_round('r', 4)} AS recall, {sql_round('f', 4)} AS f1 FROM o"""


def _q_schemas(spark, sf):
    return evaluation.span_schema_scores(span_islands(spark, sf), "gold_spans", "pred_spans")


# Identical spans pair first; then one predicted span per step, in text order, takes the first free gold span.
_SQL_SCHEMAS = _SPAN_CTES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", same AS (SELECT g.doc_id, g.sent_idx, g.tag, g.start FROM gs g
  JOIN ps p ON p.doc_id = g.doc_id AND p.sent_idx = g.sent_idx AND p.tag = g.tag AND p.start = g.start AND p."end" = g."end"),
gr AS (SELECT * FROM gs g WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.doc_id = g.doc_id AND s.sent_idx = g.sent_idx AND s.start = g.start)),
prs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY start) AS k FROM ps p
  WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.doc_id = p.doc_id AND s.sent_idx = p.sent_idx AND s.start = p.start)),
gl AS (SELECT doc_id, sent_idx, array_agg({{'tag': tag, 's': start, 'e': "end"}} ORDER BY start) AS golds FROM gr GROUP BY 1, 2),
step(doc_id, sent_idx, k, golds, used, kind, tag) AS (
  SELECT p.doc_id, p.sent_idx, CAST(0 AS BIGINT), any_value(g.golds), CAST([] AS BIGINT[]), '', '' FROM prs p LEFT JOIN gl g USING (doc_id, sent_idx) GROUP BY 1, 2
  UNION ALL
  SELECT doc_id, sent_idx, k, golds, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.s) END,
    CASE WHEN hit IS NULL THEN 'spurious' WHEN hit.s = ps AND hit.e = pe THEN 'bounds' WHEN hit.tag = ptag THEN 'type' ELSE 'touch' END, ptag
  FROM (SELECT s.doc_id, s.sent_idx, p.k, s.golds, s.used, p.start AS ps, p."end" AS pe, p.tag AS ptag,
      list_filter(s.golds, lambda x: x.s < p."end" AND p.start < x.e AND NOT list_contains(s.used, x.s))[1] AS hit
    FROM step s JOIN prs p ON p.doc_id = s.doc_id AND p.sent_idx = s.sent_idx AND p.k = s.k + 1)),
kinds AS (SELECT tag, 'same' AS kind, count(*) AS n FROM same GROUP BY tag
  UNION ALL SELECT tag, kind, count(*) FROM step WHERE k > 0 GROUP BY 1, 2
  UNION ALL SELECT g.tag, 'missed', count(*) FROM gr g LEFT JOIN (SELECT doc_id, sent_idx, unnest(used) AS s FROM (
      SELECT doc_id, sent_idx, arg_max(used, k) AS used FROM step GROUP BY 1, 2)) u ON u.doc_id = g.doc_id AND u.sent_idx = g.sent_idx AND u.s = g.start
    WHERE u.s IS NULL GROUP BY g.tag),
oc AS (SELECT tag, n, schema, CASE WHEN kind IN ('missed', 'spurious') THEN kind WHEN kind = 'same' THEN 'correct'
    WHEN kind = 'bounds' THEN CASE WHEN schema IN ('exact', 'partial') THEN 'correct' ELSE 'incorrect' END
    WHEN kind = 'type' THEN CASE schema WHEN 'partial' THEN 'partial' WHEN 'ent_type' THEN 'correct' ELSE 'incorrect' END
    ELSE CASE schema WHEN 'partial' THEN 'partial' ELSE 'incorrect' END END AS o
  FROM kinds, (VALUES ('strict'), ('exact'), ('partial'), ('ent_type')) AS v(schema)),
ct AS (SELECT schema, coalesce(tag, 'overall') AS tag, CAST(coalesce(sum(n) FILTER (WHERE o = 'correct'), 0) AS BIGINT) AS correct,
    CAST(coalesce(sum(n) FILTER (WHERE o = 'incorrect'), 0) AS BIGINT) AS incorrect, CAST(coalesce(sum(n) FILTER (WHERE o = 'partial'), 0) AS BIGINT) AS partial,
    CAST(coalesce(sum(n) FILTER (WHERE o = 'missed'), 0) AS BIGINT) AS missed, CAST(coalesce(sum(n) FILTER (WHERE o = 'spurious'), 0) AS BIGINT) AS spurious
  FROM oc GROUP BY GROUPING SETS ((schema, tag), (schema))),
g2 AS (SELECT *, correct + CASE WHEN schema IN ('partial', 'ent_type') THEN 0.5 ELSE 0.0 END::DOUBLE * partial AS good,
    correct + incorrect + partial + spurious AS actual, correct + incorrect + partial + missed AS possible FROM ct)
SELECT schema, tag, correct, incorrect, partial, missed, spurious, {sql_prf('good', 'actual', 'possible')} FROM g2"""


def mlm_positions(spark, sf):
    """events as scored positions: user is the document, value the loss, type the category."""
    digest = seeded_hash("mlm", F.col("event_id"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("generic")).otherwise(F.lit("medical")).alias("category"),
        (F.col("value") / 10).alias("loss"),
        (F.substring(digest, 1, 1) < "6").alias("top1"),
        (F.substring(digest, 1, 1) < "b").alias("top5"),
    )


_SQL_POSITIONS = """pos AS (SELECT user_id AS doc, CASE WHEN event_type IN ('view', 'click') THEN 'generic' ELSE 'medical' END AS category,
  CAST(value / 10 AS DECIMAL(28,10)) AS loss, substr(md5('mlm|' || CAST(event_id AS VARCHAR)), 1, 1) AS d FROM events)"""


def _q_buckets(spark, sf):
    return evaluation.mlm_buckets(mlm_positions(spark, sf))


_SQL_BUCKETS = with_ctes(_SQL_POSITIONS) + f"""SELECT coalesce(category, 'overall') AS category, count(*) AS n_masked,
  {sql_round('sum(loss)::DOUBLE / count(*)', 6)} AS cross_entropy, {sql_round('exp(sum(loss)::DOUBLE / count(*))', 6)} AS pseudo_perplexity,
  {sql_round("count(*) FILTER (WHERE d < '6')::DOUBLE / count(*)", 6)} AS top1_accuracy, {sql_round("count(*) FILTER (WHERE d < 'b')::DOUBLE / count(*)", 6)} AS top5_accuracy
FROM pos GROUP BY GROUPING SETS ((category), ())"""


def _q_doc_losses(spark, sf):
    return evaluation.document_losses(mlm_positions(spark, sf), "doc")


_SQL_DOC_LOSSES = with_ctes(_SQL_POSITIONS) + f"""SELECT count(*) AS n_documents, {sql_round('avg(m)', 6)} AS mean_loss, {sql_round('min(m)', 6)} AS min_loss,
  {sql_round('quantile_cont(m, 0.25)', 6)} AS p25_loss, {sql_round('quantile_cont(m, 0.5)', 6)} AS median_loss, {sql_round('quantile_cont(m, 0.75)', 6)} AS p75_loss,
  {sql_round('max(m)', 6)} AS max_loss FROM (SELECT doc, sum(loss)::DOUBLE / count(*) AS m FROM pos GROUP BY doc)"""


QUERIES = {
    "gold_match": _q_match,
    "code_scores": _q_code_scores,
    "hallucinations": _q_hallucinations,
    "missing_files": _q_missing_files,
    "evaluation_summary": _q_summary,
    "tag_scores": _q_tags,
    "span_schema_scores": _q_schemas,
    "loose_overlap": _q_loose,
    "score_averages": _q_averages,
    "mlm_buckets": _q_buckets,
    "document_losses": _q_doc_losses,
}

ORACLES = {
    "gold_match": _SQL_EVAL_ALL
    + """SELECT codigo, pk AS pactivo_key, rk AS reacadv_key, count(*) AS gold_rows, count(*) FILTER (WHERE matched) AS matched,
  count(*) FILTER (WHERE frequency_ok) AS frequency_ok, count(*) FILTER (WHERE system_ok) AS system_ok FROM hit GROUP BY 1, 2, 3""",
    "code_scores": _SQL_EVAL
    + "SELECT codigo, gold_rows, predicted_rows, matched, frequency_ok, system_ok, hallucinated, file_missing FROM full_scores",
    "hallucinations": _SQL_EVAL_ALL + "SELECT codigo, pactivo, reacadv, frecuencia, sistema FROM inv",
    "missing_files": _SQL_EVAL + "SELECT codigo, gold_rows FROM full_scores WHERE file_missing",
    "evaluation_summary": _SQL_EVAL
    + f"""SELECT count(*) AS total_codes, count(*) FILTER (WHERE file_missing) AS missing_files, CAST(sum(gold_rows) AS BIGINT) AS gold_rows,
  CAST(sum(predicted_rows) AS BIGINT) AS predicted_rows, CAST(sum(matched) AS BIGINT) AS matched,
  {sql_round('(sum(matched) * 100)::DOUBLE / sum(gold_rows)::DOUBLE', 2)} AS detection_rate FROM full_scores""",
    "tag_scores": _SQL_TAGS,
    "span_schema_scores": _SQL_SCHEMAS,
    "loose_overlap": _SQL_LOOSE,
    "score_averages": _SQL_AVERAGES,
    "mlm_buckets": _SQL_BUCKETS,
    "document_losses": _SQL_DOC_LOSSES,
}
