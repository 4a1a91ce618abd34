"""Quality rules: repetition within a text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import GAP, WORD, ascii_lower, packed_row, saved, unpacked, whole, word_count, words_of

SYMBOLS = "#*$%&|<>"
#: Fewest words of a text, and the share (percent) of words in repeated windows that fails it.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line is common if at least so many distinct texts of its host hold it, whatever the host's size.
LINE_TEXTS = 10
#: A text is depleted if fewer than this percent of its words are in lines that stay.
LEAST_LEFT = 30


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def normal_line(line: Column) -> Column:
    """Lower-cased A-Z, runs of white space as one space, digits as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(ascii_lower(line), GAP, " ")), "[0-9]+", "0")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, as an ordered pass over window digests.

    Windows become (digest, start), sorted; starts whose neighbour has the same digest are repeated; sorted
    again, each start covers the words up to the next one, three at most.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))
    same = lambda a, b: F.coalesce(F.get(a, b)["h"], F.lit(None).cast("long"))

    def starts(s):
        return F.array_sort(F.transform(
            F.filter(s, lambda x, k: x["h"].eqNullSafe(F.when(k > 0, same(s, k - 1))) | x["h"].eqNullSafe(same(s, k + 1))),
            lambda x: x["i"]))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct(
            (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])

    return F.when(n < 3, F.lit(0)).otherwise(_with(F.sort_array(windows), lambda s: _with(starts(s), covered))).cast("long")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_measures(text: Column) -> dict[str, Column]:
    """The base measures of a whole text: see ``judge_texts``."""
    return {
        "n_words": word_count(text),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _with(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _with(words_of(text), repeated_words),
    }


def judge_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of each text: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_line_words (words in common lines), kept.

    Lines are normalised and digested; a line is common in its host by the number of distinct texts that hold it, so
    copies of one text count once: a text copied often is a matter for deduplication, and its lines aren't boilerplate. The
    limit is one number at every size of a host, so added rows never make a common line rare. A text whose words are mostly in common lines is depleted and goes, as does
    one that fails the base rules. Null texts are empty and fail; null hosts are one host; repeated rows
    are judged each; an empty table gives no rows.
    """
    return _judged(docs, key, text, host).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the rows that ``judge_texts`` doesn't keep, and without the common lines in ``text``.

    The other lines, those without words too, stay as they are; so do other columns, repeated rows and clashing names.
    """
    kept = _judged(docs, key, text, host).where("kept").select("row", "places").dropDuplicates(["row"])
    rows = docs.select(_row(text, host).alias("_row"), packed_row(docs))
    rows = rows.join(kept.select(F.col("row").alias("_row"), F.col("places").alias("_places")), "_row")
    body = F.col("_doc")[text]
    left = _with(F.split(body, "\n", -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_places")), lambda i: F.get(x, i)), "\n"))
    return rows.select(*unpacked(docs, **{text: F.when(F.col("_places").isNull(), body).otherwise(left)}))


def _row(text: str, host: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(host), F.lit("\x01")), whole(text)), 256)


def _judged(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The columns of ``judge_texts``, with the row's digest and the places of its common lines (from 0; null: none)."""
    body = whole(text)
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: x["line"].rlike(WORD))
    lines = F.transform(lines, lambda x: F.struct(normal_line(x["line"]).alias("line"), x["i"].alias("i")))
    per_line = F.transform(lines, lambda x: F.struct(
        F.xxhash64(x["line"]).alias("h"), (F.size(F.split(x["line"], " "))).alias("n"), x["i"].alias("i")))
    measured = saved(docs.select(
        F.col(key), F.col(host).alias("host"), _row(text, host).alias("row"), per_line.alias("lines"),
        *[column.alias(name) for name, column in text_measures(body).items()]))
    texts = measured.groupBy("row").agg(F.first("host").alias("host"), F.first("lines").alias("lines"))
    held = texts.select("host", "row", F.explode("lines").alias("line")).select("host", "row", "line.*")
    once = held.groupBy("row", "h").agg(F.first("host").alias("host"), F.sum("n").alias("n"), F.collect_list("i").alias("at"))
    counts = once.groupBy("host", "h").agg(F.count("*").alias("texts")).where(F.col("texts") >= LINE_TEXTS)
    o, c = once.alias("o"), counts.alias("c")
    lost = o.join(c, F.col("o.host").eqNullSafe(F.col("c.host")) & (F.col("o.h") == F.col("c.h"))).groupBy("o.row").agg(
        F.sum("o.n").alias("n_line_words"), F.flatten(F.collect_list("o.at")).alias("places"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    gone = F.coalesce("n_line_words", F.lit(0))
    depleted = 100 * (F.col("n_words") - gone) < LEAST_LEFT * F.col("n_words")
    return measured.join(lost, "row", "left").select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_line_words"), (~failed & ~depleted).alias("kept"), "row", "places")
