"""Registered queries: text, keys, prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossmark.functions import keys, labels, prompts, text
from glossmark.functions.numeric import argmax, cosine, top_k_hit, warmup_steps
from glossmark.operators import masking, quality, subwords
from glossmark.plans.inputs import (
    SQL_ANNOTATIONS, annotations, documents, hashed_sentences, SQL_WORDS, sql_round, sql_trim, spread, table, with_ctes,
)
from glossmark.sources.tables import with_section

MARKER = "que"
NOTICE = "reference notice"


def _q_fold(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.md5(text.fold(F.col("text"))).alias("fold_md5"),
        (F.length(text.fold(F.col("text"))) - F.length("text")).alias("drift"),
    )


def _q_casefold(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.nfkc_casefold("text")).alias("form_md5"))


def _messy_code():
    padded = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    return F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(" ")).otherwise(F.lit(" ")),
        padded,
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(".0")).otherwise(F.lit("")),
        F.lit("\n"),
    )


_SQL_MESSY = """(CASE WHEN s_suppkey % 2 = 0 THEN chr(160) ELSE ' ' END || lpad(CAST(s_suppkey AS VARCHAR), 5, '0')
  || CASE WHEN s_suppkey % 3 = 0 THEN '.0' ELSE '' END || chr(10))"""


def _q_codes(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", _messy_code().alias("c"))
    return rows.select(
        "s_suppkey",
        keys.normalise_code(F.col("c")).alias("code"),
        keys.clean_code(F.col("c")).alias("clean"),
        text.norm_lower(F.concat(F.col("c"), F.lit("ÉX "))).alias("norm"),
    )


def _q_variant_keys(spark, sf):
    code = keys.variant_code(F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.col("c_custkey") % 3)
    rows = table(spark, sf, "customer").select("c_custkey", code.alias("code"))
    return rows.select(
        "c_custkey",
        "code",
        keys.parent_code(F.col("code")).alias("parent"),
        keys.variant_key(F.col("code")).alias("variant_key"),
        keys.variant_key(keys.parent_code(F.col("code"))).alias("parent_key"),
    )


def _q_word_stats(spark, sf):
    return documents(spark, sf, "lang").select(
        "doc_id", "lang",
        text.word_count(F.col("text")).cast("long").alias("n_words"),
        F.length("text").cast("long").alias("chars"),
        F.size(text.words(F.col("text"))).cast("long").alias("n_scanned"),
    )


_SQL_WORD_COUNT = "len(regexp_extract_all({t}, '[^\\s]+'))"


def _q_five_numbers(spark, sf):
    out = quality.lengths(documents(spark, sf, "lang"), "text", ["lang"])
    return out.select("lang", "measure", "n", "min", "p25", "median", "p75", "max", F.bround("mean", 6).alias("mean"))


_SQL_FIVE = with_ctes(
    f"""m AS (SELECT lang, 'words' AS measure, {_SQL_WORD_COUNT.format(t='text')} AS v FROM documents
  UNION ALL SELECT lang, 'chars', length(text) FROM documents)""",
    "r AS (SELECT lang, measure, v, row_number() OVER (PARTITION BY lang, measure ORDER BY v) - 1 AS k, "
    "count(*) OVER (PARTITION BY lang, measure) AS n FROM m)",
) + f"""SELECT lang, measure, n, CAST(min(v) AS DOUBLE) AS min,
  CAST(max(v) FILTER (WHERE k = greatest(0, CAST(floor(n * 0.25) AS BIGINT) - 1)) AS DOUBLE) AS p25,
  (max(v) FILTER (WHERE k = (n - 1) // 2) + max(v) FILTER (WHERE k = n // 2)) / 2.0 AS median,
  CAST(max(v) FILTER (WHERE k = least(n - 1, CAST(floor(n * 0.75) AS BIGINT))) AS DOUBLE) AS p75,
  CAST(max(v) AS DOUBLE) AS max, {sql_round('sum(v)::DOUBLE / n', 6)} AS mean
FROM r GROUP BY lang, measure, n"""


def _q_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


# A table, nested lists and references of every form before each page, and what they give.
_LAYOUT = ("<table><tr><td><p>3 &euro;</p></td><th>&#x3b1;&#946;</th></tr></table><ol><li>Uno<ul><li>&Ntilde;u</li><li>"
           "&#225;&hellip;</ul></li><li title='a>b'>&amp;eacute;</li></ol>")
_LAYOUT_TEXT = "3 € αβ \n1. Uno\n  - Ñu\n  - á…\n2. &eacute;\n"


def _q_html(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", text.html_text(F.concat(F.lit(_LAYOUT), "html")).alias("t")).select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars")
    )


# The references of the given pages.
_PAGE_REFERENCES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _sql_html():
    out = "regexp_replace(html, '<!--.*?(-->|$)', '', 'gs')"
    out = f"regexp_replace({out}, '<(script|style)\\b.*?</(script|style)>', '', 'gsi')"
    out = f"regexp_replace({out}, '<br\\s*/?>', chr(10), 'gi')"
    out = f"regexp_replace(regexp_replace({out}, '<li\\b[^>]*>', chr(1), 'gi'), '</(p|div|li|tr|h[1-6]|table|ul|ol)>', chr(2), 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    # block ends at the start of a line go, others break it; an item starts its own line
    out = f"regexp_replace(regexp_replace({out}, '\\x02+', chr(2), 'g'), '(^|\\n)\\x02', '\\1', 'g')"
    out = f"regexp_replace(replace({out}, chr(2), chr(10)), '([^\\n])\\x01', '\\1' || chr(10) || chr(1), 'g')"
    out = f"replace({out}, chr(1), '- ')"
    for reference, char in _PAGE_REFERENCES.items():
        out = f"replace({out}, '{reference}', '{char}')"
    return f"'{_LAYOUT_TEXT}' || {out}"


def _q_sanitise(spark, sf):
    cleaned = text.sanitise_section(F.col("text"), MARKER)
    return documents(spark, sf).select(
        "doc_id", F.md5(cleaned).alias("text_md5"), F.length(cleaned).cast("long").alias("chars")
    )


_SQL_SANITISE = """WITH c AS (SELECT doc_id, replace(replace(text, '|', ''), '---', '') AS t FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM c),
p AS (SELECT doc_id, t, lines, list_position(list_transform(lines, lambda x: contains(lower(x), 'que')), true) AS hit FROM l),
o AS (SELECT doc_id, CASE WHEN hit IS NULL OR hit = 0 THEN t ELSE array_to_string(lines[1:hit - 1], chr(10)) END AS s FROM p)
SELECT doc_id, md5(s) AS text_md5, length(s) AS chars FROM o"""


def _q_excerpt(spark, sf):
    cut = text.excerpt(F.col("text"), MARKER, 1500)
    return documents(spark, sf).select("doc_id", F.md5(cut).alias("excerpt_md5"), F.length(cut).cast("long").alias("chars"))


_SQL_EXCERPT = f"""WITH b AS (SELECT doc_id, CASE WHEN strpos(text, '{MARKER}') > 1
    THEN {sql_trim(f"substr(text, 1, strpos(text, '{MARKER}') - 1)")} ELSE text END AS t FROM documents),
o AS (SELECT doc_id, CASE WHEN length(t) > 1500 THEN substr(t, 1, 1500) || chr(10) || '[...]' ELSE t END AS s FROM b)
SELECT doc_id, md5(s) AS excerpt_md5, length(s) AS chars FROM o"""


def _q_vocabulary(spark, sf):
    return masking.medical_vocabulary(table(spark, sf, "benchmark"), "text")


_STOPS = ", ".join(f"'{w}'" for w in masking.STOP_WORDS)
_SQL_FORM = "lower(replace({x}, 'ß', 'ss'))"
_SQL_VOCAB = f"""vocab AS (SELECT DISTINCT w AS word FROM (
    SELECT unnest(string_split_regex({_SQL_FORM.format(x='text')}, '[^{masking.LETTERS}]+')) AS w FROM benchmark)
  WHERE length(w) >= 4 AND w NOT IN ({_STOPS}))"""


def _q_word_category(spark, sf):
    vocabulary = masking.medical_vocabulary(table(spark, sf, "benchmark"), "text")
    scanned = documents(spark, sf, "lang").select("lang", F.explode(text.words(F.col("text"))).alias("word"))
    counted = scanned.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return (
        masking.categorise(counted, "word", vocabulary)
        .groupBy("lang", "category")
        .agg(F.sum("n").alias("n_words"), F.count("*").alias("n_forms"))
    )


_SQL_CATEGORY = with_ctes(
    _SQL_VOCAB,
    "w AS (SELECT lang, unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM documents)",
    f"""f AS (SELECT lang, word, regexp_replace({_SQL_FORM.format(x='word')},
    '^[^{masking.LETTERS}]+|[^{masking.LETTERS}]+$', '', 'g') AS form FROM w)""",
) + """SELECT lang, CASE WHEN form IN (SELECT word FROM vocab) THEN 'medical' ELSE 'generic' END AS category,
  count(*) AS n_words, count(DISTINCT word) AS n_forms FROM f GROUP BY 1, 2"""


def _q_frequency_text(spark, sf):
    rows = annotations(spark, sf)
    return rows.groupBy("frecuencia").agg(F.count("*").alias("n")).select(
        "frecuencia", quality.frequency_text(F.col("frecuencia")).alias("textual"), "n"
    )


_SQL_FREQ_MAP = "CASE upper(trim({x})) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in quality.FREQUENCY_TEXT.items()
) + " ELSE lower(trim({x})) END"


def _q_styles(spark, sf):
    turns = table(spark, sf, "conversations")
    style = prompts.style_text((F.col("turn") - 1).cast("int"))
    return turns.select("conv_id", "turn", F.md5(style).alias("style_md5"))


_SQL_STYLE = "CASE greatest(0, least(turn - 1, 2)) " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(prompts.STYLES)
) + " END"


def _q_templates(spark, sf):
    rows = table(spark, sf, "part")
    sentences = prompts.template_sentences(*[F.col(c) for c in ("p_brand", "p_name", "p_type")], F.lit("raras"), F.lit("sangre"))
    return rows.select("p_partkey", F.posexplode(sentences).alias("template", "sentence"))


_SQL_TEMPLATES = """SELECT p_partkey, template, CASE template
  WHEN 0 THEN 'Ficha de ' || p_name || ': principio ' || p_brand || ', efecto ' || p_type || ', grupo sangre, incidencia raras.'
  WHEN 1 THEN 'En el grupo sangre consta ' || p_type || ' con incidencia raras'
  WHEN 2 THEN p_type || ' obliga a vigilar a quien recibe ' || p_name
  WHEN 3 THEN 'Incidencia raras de ' || p_type || ' entre pacientes tratados con ' || p_brand || '.'
  ELSE 'El prospecto de ' || p_name || ' recoge ' || p_type || ' (sangre)' END AS sentence
FROM part, (VALUES (0), (1), (2), (3), (4)) AS k(template)"""


def _q_prompts(spark, sf):
    """One prompt per document and strategy; the configs are a literal array, not a join."""
    docs = documents(spark, sf, "source")
    rows = docs.select("doc_id", "source", "text", F.explode(F.array(*map(F.lit, prompts.STRATEGIES))).alias("strategy"))
    parts = [F.col("source"), F.lit("activo"), F.col("text")]
    extra = [F.lit("ejemplo"), F.lit("[]"), F.lit("porque")]
    made = F.coalesce(*[
        F.when(F.col("strategy") == s, prompts.extraction_prompt(s, *parts, *extra)) for s in prompts.STRATEGIES
    ])
    shown = prompts.render_messages(prompts.messages(F.lit("sistema"), ("user", made)))
    return rows.select("doc_id", "strategy", F.md5(shown).alias("prompt_md5"), F.length(shown).cast("long").alias("chars"))


_TASK = (
    "'Medicamento: ' || source || chr(10) || 'Principio activo: activo' || chr(10) || "
    "'Extrae cada reacción adversa como objeto JSON con las claves: " + ", ".join(prompts.RECORD_KEYS)
    + ".' || chr(10) || 'Frecuencias admitidas: " + "; ".join(prompts.FREQUENCY_CATEGORIES) + ".'"
)
_SQL_PROMPTS = f"""WITH k(strategy) AS (VALUES ('zero_shot'), ('few_shot'), ('chain_of_thought')),
p AS (SELECT doc_id, strategy, '[SYSTEM]' || chr(10) || 'sistema' || chr(10) || chr(10) || '[USER]' || chr(10) || {_TASK}
  || CASE WHEN strategy <> 'zero_shot' THEN chr(10) || chr(10) || 'Ejemplo de texto:' || chr(10) || 'ejemplo' ELSE '' END
  || CASE WHEN strategy = 'chain_of_thought' THEN chr(10) || chr(10) || 'Razonamiento:' || chr(10) || 'porque' ELSE '' END
  || CASE WHEN strategy <> 'zero_shot' THEN chr(10) || chr(10) || 'Respuesta del ejemplo:' || chr(10) || '[]' ELSE '' END
  || chr(10) || chr(10) || 'Texto:' || chr(10) || text || chr(10) || chr(10) || 'Devuelve solo el array JSON.' AS s
  FROM documents, k)
SELECT doc_id, strategy, md5(s) AS prompt_md5, length(s) AS chars FROM p"""


def _q_message_text(spark, sf):
    turns = table(spark, sf, "conversations")
    block = prompts.message_text(F.col("role"), F.col("text"))
    return turns.select("conv_id", "turn", F.md5(block).alias("block_md5"))


def _q_compose(spark, sf):
    lines = F.split("text", "\n")
    whole = prompts.compose_document(F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.size(lines)))
    return documents(spark, sf).select("doc_id", F.md5(whole).alias("text_md5"), F.length(whole).cast("long").alias("chars"))


_SQL_COMPOSE = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
o AS (SELECT doc_id, CASE WHEN len(x) > 1 THEN x[1] || chr(10) || chr(10) ||
    array_to_string(list_transform(x[2:], lambda s, i: CAST(i AS VARCHAR) || '. ' || s), chr(10)) ELSE x[1] END AS s FROM l)
SELECT doc_id, md5(s) AS text_md5, length(s) AS chars FROM o"""


def _q_timestamps(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    )


def _q_sublist(spark, sf):
    """Where a document's opening word pair returns in its text."""
    rows = documents(spark, sf).select("doc_id", text.words(F.col("text")).alias("w")).where(F.size("w") >= 2)
    pattern = F.slice("w", 1, 2)
    found = rows.select("doc_id", labels.find_sublist(F.col("w"), pattern).alias("at"))
    return found.select("doc_id", F.explode("at").alias("position"))


_SQL_SUBLIST = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS x FROM documents),
u AS (SELECT doc_id, x[1] AS a, x[2] AS b, x, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM w WHERE len(x) >= 2)
SELECT doc_id, i - 1 AS position FROM u WHERE t = a AND x[i + 1] = b"""


def _q_label_ids(spark, sf):
    """Ids through the vocabulary and back, and the types a sentence holds."""
    vocabulary = labels.label_vocabulary(["REACT", "ACTIVE", "FREQ", "SYS"])
    rows = hashed_sentences(spark, sf)
    ids = rows.withColumn("ids", labels.labels_to_ids(F.col("gold"), vocabulary))
    total = F.aggregate("ids", F.lit(0), lambda a, x: a + x)
    back = labels.ids_to_labels(F.col("ids"), vocabulary) == F.col("gold")
    return ids.select(
        "doc_id", "sent_idx", total.cast("long").alias("id_sum"), back.alias("round_trip"),
        F.array_join(F.array_sort(labels.label_types(F.col("gold"))), ",").alias("types"),
    )


_SQL_LABEL_IDS = with_ctes(SQL_WORDS) + """SELECT doc_id, sent_idx, CAST(sum(CASE gold WHEN 'O' THEN 0 WHEN 'B-REACT' THEN 1 WHEN 'I-REACT' THEN 2
    WHEN 'B-ACTIVE' THEN 3 WHEN 'I-ACTIVE' THEN 4 WHEN 'B-FREQ' THEN 5 WHEN 'I-FREQ' THEN 6 END) AS BIGINT) AS id_sum,
  true AS round_trip, string_agg(DISTINCT CASE gold WHEN 'O' THEN 'O' ELSE substr(gold, 3) END, ',' ORDER BY CASE gold WHEN 'O' THEN 'O' ELSE substr(gold, 3) END) AS types
FROM words GROUP BY doc_id, sent_idx"""


def _q_subwords(spark, sf):
    """Sub-word alignment with four-character pieces: ids kept, ids ignored, their sum."""
    vocabulary = labels.label_vocabulary(["REACT", "ACTIVE", "FREQ", "SYS"])
    rows = hashed_sentences(spark, sf).select(
        "doc_id", "sent_idx",
        F.transform("words", lambda w: F.ceil(F.length(w) / 4).cast("int")).alias("pieces"),
        labels.labels_to_ids(F.col("gold"), vocabulary).alias("ids"),
    )
    aligned = rows.select("doc_id", "sent_idx", labels.align_subwords(F.col("pieces"), F.col("ids")).alias("a"))
    kept = F.filter("a", lambda x: x != labels.IGNORED_ID)
    return aligned.select(
        "doc_id", "sent_idx", F.size("a").cast("long").alias("n_pieces"), F.size(kept).cast("long").alias("n_kept"),
        F.aggregate(kept, F.lit(0), lambda a, x: a + x).cast("long").alias("id_sum"),
    )


_SQL_SUBWORDS = with_ctes(SQL_WORDS) + """SELECT doc_id, sent_idx, CAST(sum(ceil(length(word) / 4.0)) AS BIGINT) AS n_pieces, count(*) AS n_kept,
  CAST(sum(CASE gold WHEN 'O' THEN 0 WHEN 'B-REACT' THEN 1 WHEN 'I-REACT' THEN 2 WHEN 'B-ACTIVE' THEN 3
    WHEN 'I-ACTIVE' THEN 4 WHEN 'B-FREQ' THEN 5 WHEN 'I-FREQ' THEN 6 END) AS BIGINT) AS id_sum
FROM words GROUP BY doc_id, sent_idx"""


def piece_table(spark, sf):
    """(piece, piece_id): beginnings of up to four letters and inner parts of up to three of the benchmark's words."""
    found = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("w")).where("w <> ''").distinct()
    heads = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substr("w", F.lit(1), n))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(8)), lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(3)), lambda n: F.concat(F.lit("##"), F.substr("w", i, n)))))
    pieces = found.select(F.explode(F.concat(heads, inner)).alias("piece")).where("piece <> '##'").distinct()
    return pieces.select("piece", F.row_number().over(Window.orderBy("piece")).alias("piece_id"))


def _encoded(spark, sf):
    return subwords.encode_sentences(hashed_sentences(spark, sf), piece_table(spark, sf))


def _q_subword_pieces(spark, sf):
    """Pieces of each sentence, their ids in order, and the labels of first pieces."""
    vocabulary = labels.label_vocabulary(["REACT", "ACTIVE", "FREQ", "SYS"])
    aligned = subwords.first_piece_labels(F.col("pieces"), labels.labels_to_ids(F.col("gold"), vocabulary))
    rows = _encoded(spark, sf).select("doc_id", "sent_idx", F.flatten("pieces").alias("ids"), aligned.alias("a"))
    return rows.select("doc_id", "sent_idx", F.size("ids").cast("long").alias("n_pieces"), F.md5(F.array_join("ids", ",")).alias("ids_md5"),
                       F.md5(F.array_join("a", ",")).alias("labels_md5"))


def _q_subword_totals(spark, sf):
    return subwords.token_totals(_encoded(spark, sf), 32)


_SQL_PIECES = SQL_WORDS.replace("dl AS (", "RECURSIVE dl AS (", 1) + """, bw AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS w FROM benchmark) WHERE w <> ''),
pc AS (SELECT DISTINCT piece FROM (SELECT substr(w, 1, n) AS piece FROM bw, range(1, 5) r(n)
  UNION ALL SELECT '##' || substr(w, i, n) FROM bw, range(2, 9) a(i), range(1, 4) b(n)) WHERE piece <> '##'),
pv AS MATERIALIZED (SELECT piece, CAST(row_number() OVER (ORDER BY piece) AS INT) AS id FROM pc),
st(word, pos, ids) AS (
  SELECT word, CAST(1 AS BIGINT), CAST([] AS INT[]) FROM (SELECT DISTINCT word FROM words WHERE length(word) <= 100)
  UNION ALL
  SELECT word, pos + n, list_append(ids, id) FROM (
    SELECT x.word, x.pos, x.ids, x.n, pv.id, max(x.n) OVER (PARTITION BY x.word) AS best
    FROM (SELECT word, pos, ids, n, (CASE WHEN pos = 1 THEN '' ELSE '##' END) || substr(word, pos, n) AS piece
      FROM st, range(1, 5) t(n) WHERE pos + n <= length(word) + 1) x JOIN pv ON pv.piece = x.piece) WHERE n = best),
en AS MATERIALIZED (SELECT w.word, coalesce(e.ids, [0]) AS ids FROM (SELECT DISTINCT word FROM words) w
  LEFT JOIN (SELECT word, ids FROM st WHERE pos = length(word) + 1) e ON e.word = w.word),
sw AS (SELECT doc_id, sent_idx, i, gold, ids, CASE gold WHEN 'O' THEN 0 WHEN 'B-REACT' THEN 1 WHEN 'I-REACT' THEN 2 WHEN 'B-ACTIVE' THEN 3
    WHEN 'I-ACTIVE' THEN 4 WHEN 'B-FREQ' THEN 5 WHEN 'I-FREQ' THEN 6 WHEN 'B-SYS' THEN 7 WHEN 'I-SYS' THEN 8 END AS l FROM words JOIN en USING (word)),
ss AS (SELECT doc_id, sent_idx, sum(len(ids)) AS n, count(*) AS words, count(*) FILTER (WHERE ids = [0]) AS unknown,
    string_agg(array_to_string(ids, ','), ',' ORDER BY i) AS ids, string_agg(CAST(l AS VARCHAR) || repeat(',-100', len(ids) - 1), ',' ORDER BY i) AS labels
  FROM sw GROUP BY 1, 2)"""


def _q_logits(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        argmax(F.col("embedding")).alias("predicted"),
        top_k_hit(F.col("embedding"), F.lit(0), 1).alias("top1"),
        top_k_hit(F.col("embedding"), F.lit(0), 5).alias("top5"),
    )


def _q_cosine(spark, sf):
    """Each vector against its successor, at the system threshold."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    after = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("label_b")
    )
    score = cosine(F.col("embedding"), F.col("b"))
    return vectors.join(after, "vec_id").select(
        "vec_id", F.bround(score, 6).alias("cosine"), ((F.col("label") == F.col("label_b")) | (score >= 0.8)).alias("agrees")
    )


_SQL_COSINE = f"""WITH p AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c,
  a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {sql_round('c', 6)} AS cosine, (la = lb OR c >= 0.8) AS agrees FROM p"""


def _q_warmup(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", "n", warmup_steps(F.col("n"), 16, 10, 0.1).alias("warmup_steps")
    )


def _q_sections(spark, sf):
    """Pages of one site family as drug records: the first 'p' section with content."""
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    cells = F.filter(
        F.transform(
            F.split("html", "<p>"),
            lambda s, i: F.struct(
                F.concat(F.lit("4."), (i % 9).cast("string")).alias("seccion"),
                F.when(F.length(s) > 40, s).alias("contenido"),
            ),
        ),
        lambda s: s["seccion"] != "4.0",
    )
    return with_section(pages.withColumn("secciones", cells), "4.8").select(
        "page_id", F.md5("contenido").alias("content_md5")
    )


_SQL_SECTIONS = """WITH s AS (SELECT page_id, string_split(html, '<p>') AS x FROM pages)
SELECT page_id, md5(x[9]) AS content_md5 FROM s WHERE length(x[9]) > 40"""


QUERIES = {
    "fold_text": _q_fold,
    "casefold_text": _q_casefold,
    "code_normalise": _q_codes,
    "variant_keys": _q_variant_keys,
    "word_char_stats": _q_word_stats,
    "five_number_lengths": _q_five_numbers,
    "url_slug": _q_slug,
    "html_text": _q_html,
    "section_cut": _q_sanitise,
    "section_filter": _q_sections,
    "text_excerpt": _q_excerpt,
    "medical_vocabulary": _q_vocabulary,
    "word_category": _q_word_category,
    "frequency_text": _q_frequency_text,
    "style_pick": _q_styles,
    "template_sentences": _q_templates,
    "extraction_prompts": _q_prompts,
    "message_blocks": _q_message_text,
    "compose_document": _q_compose,
    "iso_timestamps": _q_timestamps,
    "sublist_search": _q_sublist,
    "label_ids": _q_label_ids,
    "subword_alignment": _q_subwords,
    "subword_pieces": _q_subword_pieces,
    "subword_totals": _q_subword_totals,
    "logit_ranks": _q_logits,
    "cosine_agreement": _q_cosine,
    "warmup_steps": _q_warmup,
}

ORACLES = {
    "fold_text": "SELECT doc_id, md5(lower(strip_accents(text))) AS fold_md5, 0 AS drift FROM documents",
    "casefold_text": f"SELECT doc_id, md5({_SQL_FORM.format(x=sql_trim('text'))}) AS form_md5 FROM documents",
    "code_normalise": f"""WITH c AS (SELECT s_suppkey, {_SQL_MESSY} AS c FROM supplier),
d AS (SELECT s_suppkey, c, trim(replace(replace(c, chr(160), ''), chr(10), '')) AS k FROM c)
SELECT s_suppkey, regexp_replace(k, '^(\\d+)\\.0$', '\\1') AS code, k AS clean, lower({sql_trim("c || 'ÉX '")}) AS norm FROM d""",
    "variant_keys": """WITH c AS (SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, CAST(c_custkey % 3 AS VARCHAR) AS v FROM customer)
SELECT c_custkey, p || '_v' || v AS code, p AS parent, CAST(CAST(p AS INT) AS VARCHAR) || '_v' || v AS variant_key,
  CAST(CAST(p AS INT) AS VARCHAR) AS parent_key FROM c""",
    "word_char_stats": f"""SELECT doc_id, lang, {_SQL_WORD_COUNT.format(t='text')} AS n_words, length(text) AS chars,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_scanned FROM documents""",
    "five_number_lengths": _SQL_FIVE,
    "url_slug": """WITH s AS (SELECT page_id, trim(substr(regexp_replace(lower(url), '[^\\pL\\pN]', '_', 'g'), 1, 40), '_') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM s""",
    "html_text": f"WITH t AS (SELECT page_id, {_sql_html()} AS t FROM pages) SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM t",
    "section_cut": _SQL_SANITISE,
    "section_filter": _SQL_SECTIONS,
    "text_excerpt": _SQL_EXCERPT,
    "medical_vocabulary": with_ctes(_SQL_VOCAB) + "SELECT word FROM vocab",
    "word_category": _SQL_CATEGORY,
    "frequency_text": with_ctes(SQL_ANNOTATIONS)
    + f"SELECT frecuencia, coalesce({_SQL_FREQ_MAP.format(x='frecuencia')}, 'frecuencia no conocida') AS textual, count(*) AS n FROM ann GROUP BY 1, 2",
    "style_pick": f"SELECT conv_id, turn, md5({_SQL_STYLE}) AS style_md5 FROM conversations",
    "template_sentences": _SQL_TEMPLATES,
    "extraction_prompts": _SQL_PROMPTS,
    "message_blocks": "SELECT conv_id, turn, md5('[' || upper(role) || ']' || chr(10) || text) AS block_md5 FROM conversations",
    "compose_document": _SQL_COMPOSE,
    "iso_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    "sublist_search": _SQL_SUBLIST,
    "label_ids": _SQL_LABEL_IDS,
    "subword_alignment": _SQL_SUBWORDS,
    "subword_pieces": with_ctes(_SQL_PIECES)
    + "SELECT doc_id, sent_idx, CAST(n AS BIGINT) AS n_pieces, md5(ids) AS ids_md5, md5(labels) AS labels_md5 FROM ss",
    "subword_totals": with_ctes(_SQL_PIECES) + """SELECT count(*) AS sentences, CAST(sum(words) AS BIGINT) AS words, CAST(sum(unknown) AS BIGINT) AS unknown,
  CAST(sum(n) AS BIGINT) AS pieces, CAST(sum(least(n + 2, 32)) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE n + 2 > 32) AS BIGINT) AS cut FROM ss""",
    "logit_ranks": """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS predicted,
  len(list_filter(embedding, lambda v: v > embedding[1])) < 1 AS top1, len(list_filter(embedding, lambda v: v > embedding[1])) < 5 AS top5 FROM embeddings""",
    "cosine_agreement": _SQL_COSINE,
    "warmup_steps": "SELECT lang, count(*) AS n, CAST(ceil(ceil(count(*) / 16.0) * 10 * 0.1) AS BIGINT) AS warmup_steps FROM documents GROUP BY lang",
}
