"""Registered queries: example selection, prompt tables, model responses, consolidation, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmark.functions import prompts
from glossmark.functions.labels import ENTITY_COLUMNS
from glossmark.functions.text import fold, words
from glossmark.operators import consolidation, evaluation, masking, ordering, responses, selection
from glossmark.plans.inputs import (
    ANNOTATION_ORDER, ROW_ID, SQL_ANNOTATIONS, SQL_ORDER, annotations, documents, spread, table, with_ctes,
)
from glossmark.plans.tagging_queries import SQL_ATOMS
from glossmark.plans.text_queries import _SQL_FORM, _SQL_FREQ_MAP, _SQL_VOCAB

_ANN = with_ctes(SQL_ANNOTATIONS)


# --- selection ------------------------------------------------------------------


def _q_index(spark, sf):
    index = selection.candidate_index(annotations(spark, sf))
    return index.select("codigo", F.array_join("frecuencias", "|").alias("frecuencias"), "n_frecuencias", "n_reacciones")


_SQL_INDEX = """idx AS (SELECT codigo, list_sort(array_agg(DISTINCT trim(coalesce(frecuencia, '')))) AS fs,
    count(DISTINCT trim(coalesce(frecuencia, ''))) AS nf, count(*) AS nr FROM ann GROUP BY codigo)"""


def _orders_index(spark, sf):
    """Customers as candidates, order priorities as categories: few rows each, so every step can pick."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("codigo"), F.col("o_orderpriority").alias("frecuencia")
    )
    return selection.candidate_index(rows)


def _q_greedy(spark, sf):
    return selection.greedy_examples(_orders_index(spark, sf), 2, 42).select(
        "step", "codigo", "score", F.array_join("frecuencias", "|").alias("frecuencias")
    )


_SQL_GREEDY = """WITH idx AS (SELECT CAST(o_custkey AS VARCHAR) AS codigo, list_sort(array_agg(DISTINCT trim(o_orderpriority))) AS fs, count(*) AS nr,
  md5('42|' || CAST(o_custkey AS VARCHAR)) AS d FROM orders GROUP BY o_custkey),
a AS (SELECT codigo, fs, d, 1000 * len(fs) - nr AS score FROM idx WHERE 1000 * len(fs) - nr >= -1 ORDER BY 4 DESC, d LIMIT 1),
n AS (SELECT i.codigo, i.fs, i.d, 1000 * count(*) FILTER (WHERE NOT list_contains(a.fs, u.f)) - any_value(i.nr) AS score
  FROM idx i, a, LATERAL (SELECT unnest(i.fs) AS f) u WHERE i.codigo <> a.codigo GROUP BY 1, 2, 3),
b AS (SELECT codigo, fs, score FROM n WHERE score >= -1 ORDER BY score DESC, d LIMIT 1)
SELECT 1 AS step, codigo, score, array_to_string(fs, '|') AS frecuencias FROM a UNION ALL SELECT 2, codigo, score, array_to_string(fs, '|') FROM b"""


def _q_best(spark, sf):
    index = selection.candidate_index(annotations(spark, sf))
    return selection.best_candidate(index, exclude="000003").select("codigo", "n_frecuencias", "n_reacciones")


def _q_round_robin(spark, sf):
    picked = selection.round_robin(annotations(spark, sf), "codigo", 6, 9, ROW_ID)
    return picked.groupBy("codigo", "frecuencia", "round").agg(F.count("*").alias("n"), F.min("pick").alias("first_pick"))


_SQL_ROUND_ROBIN = _ANN + """, b AS (SELECT codigo, frecuencia, row_number() OVER (PARTITION BY codigo, frecuencia
    ORDER BY md5('9|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS round,
    md5('9|' || codigo || '|' || frecuencia) AS bh FROM ann WHERE coalesce(reacadv, '') <> '' AND coalesce(sistema, '') <> '' AND coalesce(frecuencia, '') <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY round, bh) AS pick FROM b)
SELECT codigo, frecuencia, round, count(*) AS n, min(pick) AS first_pick FROM p WHERE pick <= 6 GROUP BY 1, 2, 3"""


def _groups(spark, sf):
    return selection.reactions_by_group(annotations(spark, sf), F.struct(*ANNOTATION_ORDER))


def _q_groups(spark, sf):
    return _groups(spark, sf).select(
        "codigo", "sistema", "frecuencia", "frecuencia_textual",
        F.array_join("reacciones", ", ").alias("reacciones"), F.size("reacciones").alias("n_reactions"),
    )


_SQL_GROUPS = f"""gr AS (SELECT codigo, sistema, frecuencia, coalesce({_SQL_FREQ_MAP.format(x='frecuencia')}, 'frecuencia no conocida') AS textual,
    string_agg(DISTINCT reacadv, ', ' ORDER BY reacadv) AS list, count(DISTINCT reacadv) AS n, min(row({SQL_ORDER})) AS seen
  FROM ann WHERE frecuencia IS NOT NULL AND sistema IS NOT NULL GROUP BY codigo, sistema, frecuencia)"""


def _q_table(spark, sf):
    return selection.reaction_table(_groups(spark, sf)).select("codigo", F.md5("table_text").alias("table_md5"))


_SQL_TABLE = with_ctes(SQL_ANNOTATIONS, _SQL_GROUPS) + """, sy AS (SELECT codigo, sistema, min(seen) AS seen,
    string_agg('  ' || textual || ': ' || list, chr(10) ORDER BY seen) AS body FROM gr GROUP BY 1, 2)
SELECT codigo, md5(string_agg(sistema || chr(10) || body, chr(10) ORDER BY seen)) AS table_md5 FROM sy GROUP BY codigo"""


def _q_reasoning(spark, sf):
    return selection.reasoning_text(_groups(spark, sf)).select("codigo", F.md5("reasoning").alias("reasoning_md5"))


_SQL_REASONING = with_ctes(SQL_ANNOTATIONS, _SQL_GROUPS) + """, sy AS (SELECT codigo, sistema, min(seen) AS seen,
    string_agg(frecuencia, ', ' ORDER BY frecuencia) AS freqs,
    string_agg('- ' || sistema || ' / ' || frecuencia || ': ' || list, chr(10) ORDER BY seen) AS pairs FROM gr GROUP BY 1, 2)
SELECT codigo, md5('1. Sistemas presentes:' || chr(10) || string_agg('- ' || sistema, chr(10) ORDER BY seen)
  || chr(10) || '2. Frecuencias de cada sistema:' || chr(10) || string_agg('- ' || sistema || ': ' || freqs, chr(10) ORDER BY seen)
  || chr(10) || '3. Reacciones de cada par:' || chr(10) || string_agg(pairs, chr(10) ORDER BY seen)
  || chr(10) || '4. Resultado en JSON.') AS reasoning_md5 FROM sy GROUP BY codigo"""


def _q_gold_answer(spark, sf):
    rows = selection.gold_answer(annotations(spark, sf), ANNOTATION_ORDER)
    return rows.groupBy("codigo", F.md5("record").alias("record_md5")).agg(F.count("*").alias("n"))


_SQL_GOLD_ANSWER = _ANN + """SELECT codigo, md5('{"principio activo":"' || pactivo || '","reacción adversa":"' || reacadv || '","frecuencia":"' || coalesce(frecuencia, '')
  || '","trastorno":"' || sistema || '"}') AS record_md5, count(*) AS n FROM ann GROUP BY 1, 2"""


def _q_contexts(spark, sf):
    rows = selection.drug_contexts(annotations(spark, sf), ANNOTATION_ORDER)
    return rows.select("codigo", "medicamento", F.array_join("active_ingredients", "|").alias("actives"))


def _q_first_medicine(spark, sf):
    return consolidation.first_medicine(annotations(spark, sf), ANNOTATION_ORDER)


def _q_keys(spark, sf):
    """Evaluation keys of reactions with a ligature, a sharp s and spaces about them, and of frequencies with gaps."""
    rows = annotations(spark, sf).select(
        F.concat(F.lit("\u00a0"), "reacadv", F.lit(" ﬁN Straße\t")).alias("reacadv"), "frecuencia")
    return evaluation.evaluation_keys(rows, "reacadv", "frecuencia").groupBy("reacadv_key", "frecuencia_key").agg(F.count("*").alias("n"))


_SQL_KEYS = _ANN + """SELECT lower(reacadv) || ' fin strasse' AS reacadv_key, coalesce(lower(trim(frecuencia)), 'nan') AS frecuencia_key, count(*) AS n
FROM ann GROUP BY 1, 2"""

_STYLE = "Estilo: breve."


def _q_long_prompts(spark, sf):
    """One request for a full section per code, from its medicine, ingredients and reaction table."""
    about = selection.drug_contexts(annotations(spark, sf), ANNOTATION_ORDER)
    rows = about.join(selection.reaction_table(_groups(spark, sf)), "codigo")
    shown = prompts.render_messages(prompts.long_document_messages(
        F.col("medicamento"), F.array_join("active_ingredients", ", "), F.col("table_text"), F.lit(_STYLE)))
    return rows.select("codigo", F.md5(shown).alias("prompt_md5"), F.length(shown).cast("long").alias("chars"))


_OPENING = "'[SYSTEM]' || chr(10) || 'Generas textos clínicos en español.' || chr(10) || chr(10) || '[USER]' || chr(10)"
_CLOSING = "chr(10) || 'Responde con un objeto JSON: text y entities (type, canonical, surface).'"
_SQL_LONG_PROMPTS = _SQL_TABLE.rpartition("\nSELECT")[0] + f""", tt AS (SELECT codigo, string_agg(sistema || chr(10) || body, chr(10) ORDER BY seen) AS t FROM sy GROUP BY codigo),
ab AS (SELECT codigo, arg_min(medicamento, row({SQL_ORDER})) AS m, string_agg(DISTINCT pactivo, ', ' ORDER BY pactivo) AS a FROM ann GROUP BY codigo),
pr AS (SELECT codigo, {_OPENING} || 'Escribe una sección de reacciones adversas para ' || m || ' (' || a || ').' || chr(10) || '{_STYLE}' || chr(10) || 'Tabla:'
  || chr(10) || t || {_CLOSING} AS s FROM ab JOIN tt USING (codigo))
SELECT codigo, md5(s) AS prompt_md5, length(s) AS chars FROM pr"""


def _q_snippet_prompts(spark, sf):
    """Requests for one sentence about each annotated reaction; a row with a gap gives none."""
    shown = prompts.render_messages(prompts.snippet_messages(*map(F.col, ("pactivo", "reacadv", "frecuencia", "sistema")), F.lit(_STYLE)))
    rows = annotations(spark, sf).dropna(subset=["pactivo", "reacadv", "frecuencia", "sistema"])
    return rows.groupBy("codigo", F.md5(shown).alias("prompt_md5")).agg(F.count("*").alias("n"))


_SQL_SNIPPET_PROMPTS = _ANN + f"""SELECT codigo, md5({_OPENING} || 'Escribe una frase sobre ' || reacadv || ' (' || frecuencia || ', ' || sistema || ') con ' || pactivo || '.' || chr(10)
  || '{_STYLE}' || {_CLOSING}) AS prompt_md5, count(*) AS n FROM ann
WHERE pactivo IS NOT NULL AND reacadv IS NOT NULL AND frecuencia IS NOT NULL AND sistema IS NOT NULL GROUP BY 1, 2"""


# --- responses ------------------------------------------------------------------


def _answers(spark, sf):
    """events.props as model answers: fenced, bare, as an array, broken, or refused."""
    kind = F.col("event_id") % 6
    item = F.concat(
        F.lit('{"tipo":"'), F.when(F.col("event_id") % 5 == 0, F.lit("otro")).otherwise(F.lit(" react ")),
        F.lit('","canonical":"","canonica":"'), F.col("event_type"), F.lit('","surface":" '), F.col("event_type"),
        F.lit(' ","k":"'), F.get_json_object("props", "$.k"), F.lit('"}'),
    )
    text = (
        F.when(kind == 0, F.concat(F.lit("Aquí está {no}:\n```json\n"), "props", F.lit("\n```\nfin")))
        .when(kind == 1, F.concat(F.lit("Respuesta: "), "props", F.lit(" gracias")))
        .when(kind == 2, F.concat(F.lit("Lista: ["), item, F.lit(","), item, F.lit("].")))
        .when(kind == 3, F.concat(F.lit("{roto "), "props"))
        .when(kind == 4, F.concat(F.lit("[\""), "event_type", F.lit("\"]")))
        .otherwise(F.lit("No JSON"))
    )
    rows = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props"), "event_id")
    return rows.select("event_id", "user_id", "event_type", text.alias("response"))


_SQL_ANSWERS = """it AS (SELECT event_id, user_id, event_type, props, '{"tipo":"' || CASE WHEN event_id % 5 = 0 THEN 'otro' ELSE ' react ' END || '","canonical":"","canonica":"'
    || event_type || '","surface":" ' || event_type || ' ","k":"' || json_extract_string(props, '$.k') || '"}' AS item FROM events),
ans AS (SELECT event_id, user_id, event_type, CASE event_id % 6 WHEN 0 THEN 'Aquí está {no}:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'fin'
    WHEN 1 THEN 'Respuesta: ' || props || ' gracias' WHEN 2 THEN 'Lista: [' || item || ',' || item || '].' WHEN 3 THEN '{roto ' || props
    WHEN 4 THEN '["' || event_type || '"]' ELSE 'No JSON' END AS response FROM it),
cut AS (SELECT *, regexp_extract(response, '(?ms)^```[^\\n`]*\\n(.*?)\\n```[ \\t]*$', 1) AS fenced,
    CASE WHEN strpos(response, '{') > 0 AND strpos(response, '}') > 0 AND length(response) - strpos(reverse(response), '}') + 1 > strpos(response, '{')
      THEN substr(response, strpos(response, '{'), length(response) - strpos(reverse(response), '}') + 2 - strpos(response, '{')) END AS wide,
    CASE WHEN strpos(response, '[') > 0 AND strpos(response, ']') > 0 AND length(response) - strpos(reverse(response), ']') + 1 > strpos(response, '[')
      THEN substr(response, strpos(response, '['), length(response) - strpos(reverse(response), ']') + 2 - strpos(response, '[')) END AS list FROM ans),
par AS (SELECT *, CASE WHEN json_valid(list) THEN CASE WHEN json_type(list) = 'ARRAY' THEN json_extract(list, '$[*]') END END AS cells FROM cut),
rd AS (SELECT *, coalesce(len(list_filter(cells, lambda x: json_type(x) <> 'OBJECT')) = 0, false) AS ok FROM par)"""


def _q_json_object(spark, sf):
    return _answers(spark, sf).select("event_id", responses.json_object(F.col("response")).alias("object"))


def _q_json_array(spark, sf):
    items = responses.json_array(F.col("response"))
    return _answers(spark, sf).select("event_id", items.alias("i")).select(
        "event_id", F.when(F.col("i").isNotNull(), F.size("i")).alias("n_items"), F.col("i").isNull().alias("failed")
    )


_SQL_JSON_ARRAY = with_ctes(_SQL_ANSWERS) + "SELECT event_id, CASE WHEN ok THEN len(cells) END AS n_items, NOT ok AS failed FROM rd"


def _q_coerce(spark, sf):
    items = responses.coerce_entities(responses.json_array(F.col("response")))
    return _answers(spark, sf).select("event_id", F.posexplode(items).alias("pos", "e")).select(
        "event_id", "pos", "e.type", "e.canonical", "e.surface"
    )


def _sql_first(keys):
    """First non-empty field of a JSON cell x, trimmed."""
    return "trim(coalesce(" + ", ".join(f"nullif(x->>'$.{k}', '')" for k in keys) + ", ''))"


_SQL_COERCE = with_ctes(_SQL_ANSWERS) + f""", cl AS (SELECT event_id, unnest(cells) AS x, generate_subscripts(cells, 1) AS i FROM rd WHERE ok),
fl AS (SELECT event_id, i, upper({_sql_first(responses.TYPE_KEYS)}) AS type, {_sql_first(responses.CANONICAL_KEYS)} AS canonical, {_sql_first(responses.SURFACE_KEYS)} AS surface FROM cl)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS INT) AS pos, type, canonical, surface
FROM fl WHERE type IN ('REACT', 'ACTIVE', 'FREQ', 'SYS') AND surface <> ''"""


def _q_extraction(spark, sf):
    """Users as codes, event types as ingredients: one failed answer rejects the code."""
    records, status = responses.extraction_outcome(_answers(spark, sf), "user_id", "event_type", "response")
    counted = records.groupBy("user_id").agg(F.count("*").alias("records"))
    return status.join(counted, "user_id", "left").select(
        "user_id", "calls", "errors", "status", F.coalesce("records", F.lit(0).cast("long")).alias("records")
    )


_SQL_EXTRACTION = with_ctes(_SQL_ANSWERS) + """SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors,
  CASE WHEN bool_and(ok) THEN 'processed' ELSE 'error' END AS status, CASE WHEN bool_and(ok) THEN CAST(sum(len(cells)) AS BIGINT) ELSE 0 END AS records FROM rd GROUP BY user_id"""


def declared(spark, sf):
    """Each line of a document declares its first word, or its first two, or a word with an 'x' that may be absent."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first = F.regexp_extract("line", r"[\p{L}\p{N}_]+", 0)
    pair = F.regexp_extract("line", r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+", 0)
    types = F.array(*map(F.lit, ENTITY_COLUMNS))
    surface = F.when(F.col("pos") % 3 == 2, F.concat(first, F.lit("x"))).when(
        (F.col("pos") % 2 == 1) & (pair != ""), fold(pair)).otherwise(fold(first))
    return lines.select(
        "doc_id", "pos", F.get(types, F.col("pos") % 4).alias("type"), F.lower(first).alias("canonical"), surface.alias("surface"),
    ).where(F.length("canonical") > 0)


def _validated(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return responses.validate_declared(docs, declared(spark, sf), "doc_id")


def _q_validated(spark, sf):
    found, _ = _validated(spark, sf)
    return found.select("doc_id", "type", "canonical", "surface", F.col("start").cast("long"), F.col("end").cast("long"))


def _q_discards(spark, sf):
    _, outcome = _validated(spark, sf)
    return outcome.select("doc_id", "declared", "matched", "discard_ratio", "accepted")


_W = "\\pL\\pN_\\x{c0}-\\x{17f}"
_DECLARED = f"""dl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
df AS (SELECT doc_id, pos, regexp_extract(line, '[\\pL\\pN_]+') AS w, regexp_extract(line, '[\\pL\\pN_]+ [\\pL\\pN_]+') AS w2 FROM dl),
dc AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'REACT' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'FREQ' ELSE 'SYS' END AS type, lower(w) AS canonical,
    CASE WHEN pos % 3 = 2 THEN w || 'x' WHEN pos % 2 = 1 AND w2 <> '' THEN lower(strip_accents(w2)) ELSE lower(strip_accents(w)) END AS surface FROM df WHERE w <> ''),
su AS (SELECT DISTINCT doc_id, surface, lower(strip_accents(surface)) AS m FROM dc),
fa AS (SELECT su.doc_id, su.surface, min(a.s) AS s FROM su JOIN atoms a ON a.doc_id = su.doc_id AND a.tok = regexp_extract(su.m, '^([{_W}]+|[^{_W}\\s])')
  JOIN fd ON fd.doc_id = su.doc_id WHERE substr(fd.f, CAST(a.s AS BIGINT) + 1, length(su.m)) = su.m
    AND (a.s = 0 OR NOT regexp_matches(substr(fd.f, CAST(a.s AS BIGINT), 1), '[{_W}]'))
    AND NOT regexp_matches(substr(fd.f, CAST(a.s AS BIGINT) + length(su.m) + 1, 1), '[{_W}]') GROUP BY 1, 2),
lo AS (SELECT dc.*, CAST(fa.s AS BIGINT) AS start, CAST(fa.s + length(dc.surface) AS BIGINT) AS "end" FROM dc LEFT JOIN fa ON fa.doc_id = dc.doc_id AND fa.surface = dc.surface)"""
_DECLARED_CTES = with_ctes(SQL_ATOMS, _DECLARED)


def _q_failures(spark, sf):
    _, outcome = _validated(spark, sf)
    rows = responses.failure_records(outcome, "doc_id", F.lit(1), F.lit(1), F.lit(None).cast("string"))
    return rows.groupBy("reason", "kind").agg(F.count("*").alias("n"))


def entity_documents(spark, sf):
    """Labelled documents with the entities their declared lines give."""
    rows = declared(spark, sf).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type", "canonical", "surface"))).alias("e")
    )
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return rows.join(docs, "doc_id").select(
        F.col("source").alias("codigo"),
        F.concat("source", F.lit("_v"), F.col("doc_id").cast("string")).alias("codigo_variant"),
        F.col("doc_id").cast("int").alias("variante"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("source")).alias("medicamento"),
        F.transform(
            "e",
            lambda x: F.struct(
                x["type"].alias("type"),
                F.when(x["pos"] % 5 == 0, F.lit("")).otherwise(x["canonical"]).alias("canonical"),
                x["surface"].alias("surface"),
            ),
        ).alias("entities"),
    )


def _q_consolidate(spark, sf):
    names = table(spark, sf, "supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("codigo"), F.col("s_name").alias("medicamento")
    )
    rows = consolidation.consolidate(entity_documents(spark, sf), names)
    columns = ["medicamento", "pactivo", "reacadv", "frecuencia", "sistema"] + [
        f"{c}_canonical" for c in ("pactivo", "reacadv", "frecuencia", "sistema")
    ]
    return rows.select(
        "codigo", "orig_codigo", "variante", F.md5(F.concat_ws("|", *columns)).alias("row_md5")
    ).groupBy("codigo", "orig_codigo", "variante", "row_md5").agg(F.count("*").alias("n"))


_SQL_CONSOLIDATE = f"""WITH {_DECLARED.split('fa AS')[0].rstrip().rstrip(',')},
e AS (SELECT d.doc_id, d.pos, d.type, d.surface, CASE WHEN d.pos % 5 = 0 OR d.canonical = '' THEN d.surface ELSE d.canonical END AS canonical FROM dc d),
doc AS (SELECT t.doc_id, t.source, coalesce(nullif(CASE WHEN t.doc_id % 2 = 0 THEN '' ELSE t.source END, ''), s.s_name, '') AS med
  FROM documents t LEFT JOIN supplier s ON t.source = 'src' || CAST(s.s_suppkey AS VARCHAR)),
f AS (SELECT doc_id, coalesce(arg_min(surface, pos) FILTER (WHERE type = 'ACTIVE'), '') AS ps, coalesce(arg_min(canonical, pos) FILTER (WHERE type = 'ACTIVE'), '') AS pc,
  coalesce(arg_min(surface, pos) FILTER (WHERE type = 'FREQ'), '') AS fs, coalesce(arg_min(canonical, pos) FILTER (WHERE type = 'FREQ'), '') AS fc,
  coalesce(arg_min(surface, pos) FILTER (WHERE type = 'SYS'), '') AS ss, coalesce(arg_min(canonical, pos) FILTER (WHERE type = 'SYS'), '') AS sc,
  CASE WHEN bool_or(type = 'REACT') THEN 'REACT' WHEN bool_or(type = 'ACTIVE') THEN 'ACTIVE' WHEN bool_or(type = 'FREQ') THEN 'FREQ' ELSE 'SYS' END AS anchor FROM e GROUP BY doc_id),
r AS (SELECT e.doc_id, CASE WHEN anchor = 'ACTIVE' THEN surface ELSE ps END AS p, CASE WHEN anchor = 'REACT' THEN surface ELSE '' END AS re,
    CASE WHEN anchor = 'FREQ' THEN surface ELSE fs END AS fr, CASE WHEN anchor = 'SYS' THEN surface ELSE ss END AS si,
    CASE WHEN anchor = 'ACTIVE' THEN canonical ELSE pc END AS pcn, CASE WHEN anchor = 'REACT' THEN canonical ELSE '' END AS rcn,
    CASE WHEN anchor = 'FREQ' THEN canonical ELSE fc END AS fcn, CASE WHEN anchor = 'SYS' THEN canonical ELSE sc END AS scn
  FROM e JOIN f USING (doc_id) WHERE e.type = f.anchor
  UNION ALL
  SELECT doc_id, CASE WHEN type = 'ACTIVE' THEN surface ELSE '' END, '', CASE WHEN type = 'FREQ' THEN surface ELSE '' END, CASE WHEN type = 'SYS' THEN surface ELSE '' END,
    CASE WHEN type = 'ACTIVE' THEN canonical ELSE '' END, '', CASE WHEN type = 'FREQ' THEN canonical ELSE '' END, CASE WHEN type = 'SYS' THEN canonical ELSE '' END
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, surface ORDER BY pos) AS rn FROM e WHERE type <> 'REACT') WHERE rn = 1)
SELECT source || '_v' || CAST(doc_id AS VARCHAR) AS codigo, source AS orig_codigo, CAST(doc_id AS INT) AS variante,
  md5(med || '|' || p || '|' || re || '|' || fr || '|' || si || '|' || pcn || '|' || rcn || '|' || fcn || '|' || scn) AS row_md5, count(*) AS n
FROM r JOIN doc USING (doc_id) GROUP BY 1, 2, 3, 4"""


# --- masking --------------------------------------------------------------------

CAPACITY = 126


def _stream(docs, *keep):
    """Words with four-character pieces as sub-tokens."""
    rows = docs.select("doc_id", *keep, words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return rows.withColumn("sizes", F.transform("words", lambda w: F.ceil(F.length(w) / 4).cast("int")))


def _placed(spark, sf):
    return masking.window_words(_stream(documents(spark, sf)), "doc_id", "words", "sizes", CAPACITY)


def _masked(spark, sf):
    docs = ordering.mark_alone(documents(spark, sf), "doc_id")
    placed = masking.window_words(_stream(docs, "_alone"), "doc_id", "words", "sizes", CAPACITY, "_alone")
    return masking.mask_words(placed, "doc_id", alone="_alone")


def _q_windows(spark, sf):
    return _placed(spark, sf).groupBy("doc_id", "window_idx").agg(
        F.sum("size").alias("sub_tokens"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word")
    )


def _q_masks(spark, sf):
    return _masked(spark, sf).groupBy("doc_id", "window_idx", "treatment").agg(
        F.count("*").alias("n_words"), F.sum("size").alias("sub_tokens")
    )


def _q_mask_summary(spark, sf):
    """Masked sub-tokens per category: distinct masked words meet the vocabulary once."""
    masked = _masked(spark, sf).groupBy("word").agg(F.sum("size").alias("n"))
    vocabulary = masking.medical_vocabulary(table(spark, sf, "benchmark"), "text")
    return masking.categorise(masked, "word", vocabulary).groupBy("category").agg(F.sum("n").alias("sub_tokens"))


#: Window starts by a walk over each document's words, then every word cut at them.
_SQL_PLACED = f"""WITH RECURSIVE sw AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^\\s]+'), lambda x: x <> '') AS words FROM documents),
st AS (SELECT doc_id, words, list_transform(words, lambda w: CAST(ceil(length(w) / 4.0) AS BIGINT)) AS sizes FROM sw WHERE len(words) > 0),
walk(doc_id, i, place, used, cut_at, cuts, sizes) AS (
  SELECT doc_id, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, sizes FROM st
  UNION ALL
  SELECT doc_id, i + 1, place + sizes[i + 1],
    CASE WHEN sizes[i + 1] > {CAPACITY} THEN (used + sizes[i + 1]) % {CAPACITY} WHEN used + sizes[i + 1] > {CAPACITY} THEN sizes[i + 1] ELSE used + sizes[i + 1] END,
    CASE WHEN sizes[i + 1] > {CAPACITY} THEN place + {CAPACITY} - used ELSE place END,
    CASE WHEN sizes[i + 1] > {CAPACITY} THEN (used + sizes[i + 1]) // {CAPACITY} WHEN used + sizes[i + 1] > {CAPACITY} THEN 1 ELSE 0 END, sizes
  FROM walk WHERE i < len(sizes)),
ws AS (SELECT w.doc_id, cut_at + k * {CAPACITY} AS s FROM (SELECT *, unnest(range(cuts)) AS k FROM walk WHERE cuts > 0) w JOIN st ON st.doc_id = w.doc_id
  WHERE cut_at + k * {CAPACITY} < list_sum(st.sizes)),
wn AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS window_idx, lead(s, 1, 9000000000) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM ws),
wp AS (SELECT doc_id, unnest(words) AS word, unnest(sizes) AS size, generate_subscripts(words, 1) - 1 AS word_idx FROM st),
wo AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY word_idx) - size AS place FROM wp),
placed AS (SELECT wo.doc_id, window_idx, word_idx, word, least(place + wo.size, e) - greatest(place, s) AS size
  FROM wo JOIN wn ON wn.doc_id = wo.doc_id AND s < place + wo.size AND e > place),
dg AS (SELECT *, md5('42|' || CAST(doc_id AS VARCHAR) || '|' || CAST(window_idx AS VARCHAR) || '|' || CAST(word_idx AS VARCHAR)) AS d FROM placed),
dr AS (SELECT *, greatest(1, round_even(CAST(sum(size) OVER (PARTITION BY doc_id, window_idx) * 0.18 AS DECIMAL(20,6)), 0)) AS target,
    coalesce(sum(size) OVER (PARTITION BY doc_id, window_idx ORDER BY d, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dg),
masked AS (SELECT *, CASE WHEN substr(d, 9, 8) < '{round(0.8 * 2**32):08x}' THEN 'mask' WHEN substr(d, 9, 8) < '{round(0.9 * 2**32):08x}' THEN 'random' ELSE 'keep' END AS treatment
  FROM dr WHERE before < target)
"""


QUERIES = {
    "candidate_index": _q_index,
    "greedy_examples": _q_greedy,
    "best_candidate": _q_best,
    "round_robin_pick": _q_round_robin,
    "reaction_groups": _q_groups,
    "reaction_table": _q_table,
    "reasoning_text": _q_reasoning,
    "gold_answer": _q_gold_answer,
    "drug_contexts": _q_contexts,
    "json_object": _q_json_object,
    "first_medicine": _q_first_medicine,
    "evaluation_keys": _q_keys,
    "long_prompts": _q_long_prompts,
    "snippet_prompts": _q_snippet_prompts,
    "json_array": _q_json_array,
    "coerce_entities": _q_coerce,
    "extraction_run": _q_extraction,
    "validated_entities": _q_validated,
    "discard_ratios": _q_discards,
    "failure_records": _q_failures,
    "consolidate": _q_consolidate,
    "fill_windows": _q_windows,
    "mask_words": _q_masks,
    "mask_summary": _q_mask_summary,
}

ORACLES = {
    "fill_windows": _SQL_PLACED + """SELECT doc_id, window_idx, CAST(sum(size) AS BIGINT) AS sub_tokens, min(word_idx) AS first_word, max(word_idx) AS last_word
FROM placed GROUP BY 1, 2""",
    "mask_words": _SQL_PLACED + "SELECT doc_id, window_idx, treatment, count(*) AS n_words, CAST(sum(size) AS BIGINT) AS sub_tokens FROM masked GROUP BY 1, 2, 3",
    "mask_summary": _SQL_PLACED.rstrip() + ",\n" + _SQL_VOCAB + f""",
mf AS (SELECT size, regexp_replace({_SQL_FORM.format(x='word')}, '^[^{masking.LETTERS}]+|[^{masking.LETTERS}]+$', '', 'g') AS form FROM masked)
SELECT CASE WHEN form IN (SELECT word FROM vocab) THEN 'medical' ELSE 'generic' END AS category, CAST(sum(size) AS BIGINT) AS sub_tokens FROM mf GROUP BY 1""",
    "candidate_index": with_ctes(SQL_ANNOTATIONS, _SQL_INDEX)
    + "SELECT codigo, array_to_string(fs, '|') AS frecuencias, nf AS n_frecuencias, nr AS n_reacciones FROM idx",
    "greedy_examples": _SQL_GREEDY,
    "best_candidate": with_ctes(SQL_ANNOTATIONS, _SQL_INDEX)
    + "SELECT codigo, nf AS n_frecuencias, nr AS n_reacciones FROM idx WHERE codigo <> '000003' ORDER BY nf DESC, nr, codigo LIMIT 1",
    "round_robin_pick": _SQL_ROUND_ROBIN,
    "reaction_groups": with_ctes(SQL_ANNOTATIONS, _SQL_GROUPS)
    + "SELECT codigo, sistema, frecuencia, textual AS frecuencia_textual, list AS reacciones, n AS n_reactions FROM gr",
    "reaction_table": _SQL_TABLE,
    "reasoning_text": _SQL_REASONING,
    "gold_answer": _SQL_GOLD_ANSWER,
    "drug_contexts": _ANN
    + f"""SELECT codigo, arg_min(medicamento, row({SQL_ORDER})) AS medicamento, string_agg(DISTINCT pactivo, '|' ORDER BY pactivo) AS actives FROM ann GROUP BY codigo""",
    "json_object": with_ctes(_SQL_ANSWERS)
    + """SELECT event_id, CASE WHEN fenced <> '' AND json_valid(fenced) THEN fenced WHEN json_valid(wide) THEN wide END AS object FROM cut""",
    "first_medicine": _ANN + f"SELECT codigo, arg_min(medicamento, row({SQL_ORDER})) AS medicamento FROM ann WHERE medicamento IS NOT NULL GROUP BY codigo",
    "evaluation_keys": _SQL_KEYS,
    "long_prompts": _SQL_LONG_PROMPTS,
    "snippet_prompts": _SQL_SNIPPET_PROMPTS,
    "json_array": _SQL_JSON_ARRAY,
    "coerce_entities": _SQL_COERCE,
    "extraction_run": _SQL_EXTRACTION,
    "validated_entities": _DECLARED_CTES
    + 'SELECT DISTINCT doc_id, type, canonical, surface, start, "end" FROM lo WHERE start IS NOT NULL',
    "discard_ratios": _DECLARED_CTES
    + """SELECT doc_id, count(*) AS declared, count(start) AS matched, 1.0::DOUBLE - count(start)::DOUBLE / count(*)::DOUBLE AS discard_ratio,
  1.0::DOUBLE - count(start)::DOUBLE / count(*)::DOUBLE <= 0.3::DOUBLE AS accepted FROM lo GROUP BY doc_id""",
    "failure_records": _DECLARED_CTES
    + """SELECT 'discard_ratio=' || printf('%.2f', r) AS reason, 'long_doc' AS kind, count(*) AS n
FROM (SELECT 1.0::DOUBLE - count(start)::DOUBLE / count(*)::DOUBLE AS r FROM lo GROUP BY doc_id) WHERE r > 0.3::DOUBLE GROUP BY 1""",
    "consolidate": _SQL_CONSOLIDATE,
}
