"""The given tables in the roles the operators work on.

documents are the texts (source is the drug code), benchmark passages give the
mention dictionary, lineitem with part and supplier is the annotation table, and
digest-driven changes of it stand for predictions and for the consolidated
synthetic annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions.labels import bind

ANNOTATION_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: parts into which narrow scans are dealt. For inputs of few, large row groups; unset on others.
SPREAD_SETTING = "spark.glossmark.spread"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal compact rows by key where the session asks for it: one row group is one task otherwise."""
    parts = rows.sparkSession.conf.get(SPREAD_SETTING, None)
    return rows.repartition(int(parts), *keys) if parts else rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """doc_id, the named columns, and text; spread for row-local work on long texts."""
    picked = table(spark, sf_dir, "documents").select(*dict.fromkeys(["doc_id", *columns, "text"]))
    return spread(picked, "doc_id")


def digit(position: int, digest: str = "h") -> Column:
    """One hex digit of the row digest, as text."""
    return F.substring(digest, position, 1)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codigo, medicamento, pactivo, reacadv, frecuencia, sistema, row digest h, and row order."""
    flags = F.concat("l_returnflag", "l_linestatus")
    frequency = (
        F.when(flags == "AF", F.lit("FRECUENTE"))
        .when(flags == "AO", F.lit("Muy frecuente"))
        .when(flags == "NF", F.lit("POCO FRECUENTE"))
        .when(flags == "NO", F.lit("RARA"))
        .when(flags == "RF", F.lit("FRECUENCIA NO CONOCIDA"))
        .when(F.col("l_quantity") >= 10, F.lit("Muy rara"))
    )
    lines = spread(
        table(spark, sf_dir, "lineitem").select(
            *ROW_ID, "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
        ),
        "l_orderkey",
        "l_linenumber",
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("codigo"),
        F.col("s_name").alias("medicamento"),
        F.col("p_brand").alias("pactivo"),
        F.col("p_name").alias("reacadv"),
        frequency.alias("frecuencia"),
        F.col("p_type").alias("sistema"),
        F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ROW_ID])).alias("h"),
        "l_suppkey",
        *ANNOTATION_ORDER,
    )


def predictions(spark: SparkSession, sf_dir: str, absent: bool = False) -> DataFrame:
    """A changed copy of the annotations. ``absent``: some codes have none at all, for what measures missing files."""
    rows = annotations(spark, sf_dir)
    if absent:
        rows = rows.where(F.substring(F.md5("codigo"), 1, 1) >= "2")
    lower_freq = F.coalesce("frecuencia", F.lit(""))
    return rows.select(
        "codigo",
        "pactivo",
        F.when(digit(1) >= "c", F.concat(F.lit("sin "), "reacadv"))
        .when(digit(2) < "3", F.concat("reacadv", F.lit(" leve")))
        .otherwise(F.upper("reacadv"))
        .alias("reacadv"),
        F.when(digit(3) < "8", F.concat(F.lower(lower_freq), F.lit("s")))
        .when(digit(3) < "c", F.lit("otra"))
        .otherwise(lower_freq)
        .alias("frecuencia"),
        F.when(digit(4) < "4", F.lit("otro")).otherwise(F.lower("sistema")).alias("sistema"),
        *ANNOTATION_ORDER,
    )


def latin_keys(rows: DataFrame) -> DataFrame:
    """Evaluation keys by built-ins: for composed Latin text, lower case with an open eszett is the casefold."""
    def key(column: str) -> Column:
        return F.replace(F.lower(F.trim(F.coalesce(column, F.lit("nan")))), F.lit("ß"), F.lit("ss"))

    return rows.select("*", *[key(c).alias(f"{c}_key") for c in ("pactivo", "reacadv", "frecuencia", "sistema")])


def synth(spark: SparkSession, sf_dir: str, absent: bool = False) -> DataFrame:
    """Consolidated synthetic annotations: surfaces, canonical values, parent code, variant.

    ``absent``: some codes were never attempted, for what measures coverage.
    """
    rows = annotations(spark, sf_dir)
    if absent:
        rows = rows.where(F.substring(F.md5("codigo"), 2, 1) < "a")
    variant = (F.col("l_linenumber") % 2 + 1).cast("int")
    return rows.select(
        F.concat("codigo", F.lit("_v"), variant.cast("string")).alias("codigo"),
        "medicamento",
        F.when(digit(7) < "4", F.lower("pactivo")).otherwise(F.col("pactivo")).alias("pactivo"),
        F.when(digit(6) < "5", F.upper("reacadv"))
        .when(digit(6) < "8", F.concat("reacadv", F.lit(" leve")))
        .otherwise(F.col("reacadv"))
        .alias("reacadv"),
        F.when(digit(8) < "8", F.concat(F.lower("frecuencia"), F.lit("s")))
        .when(digit(8) < "c", F.lower("frecuencia"))
        .otherwise(F.lit("a menudo"))
        .alias("frecuencia"),
        F.lower("sistema").alias("sistema"),
        F.col("pactivo").alias("pactivo_canonical"),
        F.when((digit(5) < "2") | (digit(1) >= "6"), F.concat("reacadv", F.lit(" x")))
        .otherwise(F.col("reacadv"))
        .alias("reacadv_canonical"),
        F.upper("frecuencia").alias("frecuencia_canonical"),
        F.col("sistema").alias("sistema_canonical"),
        F.col("codigo").alias("orig_codigo"),
        variant.alias("variante"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, type, mention): words and word pairs of the benchmark passages, by source."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), words.alias("w")
    )
    types = F.array(*[F.lit(t) for t in ("REACT", "ACTIVE", "FREQ", "SYS")])
    single = F.transform(
        "w", lambda x, i: F.struct(F.get(types, i % 4).alias("type"), x.alias("mention"))
    )
    pairs = F.transform(
        "w",
        lambda x, i: F.struct(
            F.when(i % 2 == 0, F.lit("REACT")).otherwise(F.lit("SYS")).alias("type"),
            F.concat(x, F.lit(" "), F.get(F.col("w"), i + 1)).alias("mention"),
        ),
    )
    return (
        items.select("source", F.explode(F.concat(single, pairs)).alias("m"))
        .select("source", "m.*")
        .where(F.trim("mention") != "")
        .distinct()
    )


def hashed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent_idx, words, gold and pred labels: one row per line, labels drawn from word digests."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_idx", "line"))
    # lines without a word are told by their spaces: a condition on the words would cut each line twice
    words = lines.where(F.trim("line") != "").select(
        "doc_id", "sent_idx", F.filter(F.split("line", " "), lambda w: w != "").alias("words")
    )
    gold = words.withColumn("gold", F.transform("words", lambda w: digest_label(F.md5(w))))

    def changed(known: Column) -> Column:
        return F.transform(
            "words",
            lambda w, i: F.when(
                F.substring(F.md5(F.concat(w, F.lit("#"), i.cast("string"))), 1, 1) < "3",
                digest_label(F.md5(F.concat(w, F.lit("p")))),
            ).otherwise(F.get(known, i)),
        )

    return gold.withColumn("pred", bind(F.col("gold"), changed))


def digest_label(digest: Column) -> Column:
    labels = F.array(*[
        F.lit(x) for x in ("B-REACT", "B-REACT", "I-REACT", "B-ACTIVE", "I-ACTIVE", "B-FREQ", "I-FREQ")
    ])
    return F.coalesce(F.get(labels, F.instr(F.lit("0123456"), F.substring(digest, 1, 1)) - 1), F.lit("O"))


# --- the same roles in SQL ----------------------------------------------------

SQL_ANNOTATIONS = """ann AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS codigo, s_name AS medicamento, p_brand AS pactivo,
    p_name AS reacadv,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'FRECUENTE' WHEN 'AO' THEN 'Muy frecuente'
      WHEN 'NF' THEN 'POCO FRECUENTE' WHEN 'NO' THEN 'RARA' WHEN 'RF' THEN 'FRECUENCIA NO CONOCIDA'
      ELSE CASE WHEN l_quantity >= 10 THEN 'Muy rara' END END AS frecuencia,
    p_type AS sistema,
    md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
      CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS h,
    l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

SQL_ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"

SQL_PREDICTIONS = """pred AS (
  SELECT codigo, pactivo,
    CASE WHEN substr(h, 1, 1) >= 'c' THEN 'sin ' || reacadv WHEN substr(h, 2, 1) < '3' THEN reacadv || ' leve' ELSE upper(reacadv) END AS reacadv,
    CASE WHEN substr(h, 3, 1) < '8' THEN lower(coalesce(frecuencia, '')) || 's'
      WHEN substr(h, 3, 1) < 'c' THEN 'otra' ELSE coalesce(frecuencia, '') END AS frecuencia,
    CASE WHEN substr(h, 4, 1) < '4' THEN 'otro' ELSE lower(sistema) END AS sistema,
    l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
  FROM ann)"""
SQL_PREDICTIONS_ABSENT = SQL_PREDICTIONS.replace("FROM ann)", "FROM ann WHERE substr(md5(codigo), 1, 1) >= '2')")

SQL_SYNTH = """synth AS (
  SELECT codigo || '_v' || CAST(l_linenumber % 2 + 1 AS VARCHAR) AS codigo, medicamento,
    CASE WHEN substr(h, 7, 1) < '4' THEN lower(pactivo) ELSE pactivo END AS pactivo,
    CASE WHEN substr(h, 6, 1) < '5' THEN upper(reacadv) WHEN substr(h, 6, 1) < '8' THEN reacadv || ' leve'
      ELSE reacadv END AS reacadv,
    CASE WHEN substr(h, 8, 1) < '8' THEN lower(frecuencia) || 's' WHEN substr(h, 8, 1) < 'c'
      THEN lower(frecuencia) ELSE 'a menudo' END AS frecuencia,
    lower(sistema) AS sistema, pactivo AS pactivo_canonical,
    CASE WHEN substr(h, 5, 1) < '2' OR substr(h, 1, 1) >= '6' THEN reacadv || ' x' ELSE reacadv END AS reacadv_canonical,
    upper(frecuencia) AS frecuencia_canonical, sistema AS sistema_canonical,
    codigo AS orig_codigo, l_linenumber % 2 + 1 AS variante
  FROM ann)"""
SQL_SYNTH_ABSENT = SQL_SYNTH.replace("FROM ann)", "FROM ann WHERE substr(md5(codigo), 2, 1) < 'a')")

SQL_MENTIONS = """bw AS (
  SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS source, regexp_extract_all(text, '[\\pL\\pN]+') AS w FROM benchmark),
bi AS (SELECT source, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM bw),
mentions AS (
  SELECT DISTINCT * FROM (
    SELECT source, CASE i % 4 WHEN 0 THEN 'REACT' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'FREQ' ELSE 'SYS' END AS type,
      word AS mention FROM bi
    UNION ALL
    SELECT source, CASE i % 2 WHEN 0 THEN 'REACT' ELSE 'SYS' END, word || ' ' || w[i + 2] FROM bi
    WHERE w[i + 2] IS NOT NULL)
  WHERE trim(mention) <> '')"""

_SQL_LABEL = (
    "CASE substr({d}, 1, 1) WHEN '0' THEN 'B-REACT' WHEN '1' THEN 'B-REACT' WHEN '2' THEN 'I-REACT' "
    "WHEN '3' THEN 'B-ACTIVE' WHEN '4' THEN 'I-ACTIVE' WHEN '5' THEN 'B-FREQ' WHEN '6' THEN 'I-FREQ' ELSE 'O' END"
)

#: One row per word: doc_id, sent_idx, i, word, gold, pred (labels before any repair).
SQL_WORDS = f"""dl AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_idx
  FROM documents),
ds AS (SELECT doc_id, sent_idx, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM dl),
dw AS (SELECT doc_id, sent_idx, words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM ds),
dg AS (SELECT doc_id, sent_idx, i, word, {_SQL_LABEL.format(d="md5(word)")} AS gold FROM dw),
words AS (SELECT *, CASE WHEN substr(md5(word || '#' || CAST(i AS VARCHAR)), 1, 1) < '3'
    THEN {_SQL_LABEL.format(d="md5(word || 'p')")} ELSE gold END AS pred FROM dg)"""


def sql_round(expression: str, digits: int) -> str:
    """Half-even rounding on the decimal form, as ``bround`` does on doubles."""
    return f"CAST(round_even(CAST({expression} AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def sql_trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
