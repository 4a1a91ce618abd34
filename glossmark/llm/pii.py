"""Personal data: patterns for the plain kinds, and terms that the corpus shows to disclose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import packed_row, saved, unpacked, whole

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns without backtracking: possessive runs, and starts only where a run can begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
CUES = {"email": "@", "ip": ".", "phone": "+"}
#: Bits of an entity's information that a term leaves open, at most, for the term to be generalised or removed: from the
#: lower bound of the share of the term's documents that hold the entity, so that neither depends on the corpus' size.
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.5
#: Squared normal quantile of that bound (one-sided, 95 %).
Z2 = 2.706
#: Matches of a text that are placed in one list before it joins the others.
_BLOCK = 128
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum is a multiple of ten: every second digit from the right is doubled."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + _weighed(
        F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int"), i % 2 == 0))
    return total % 10 == 0


def _weighed(digit: Column, doubled: Column) -> Column:
    return F.when(~doubled, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Start (code points, from 0) and value of each match, from the matches and the text between them."""
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between, lambda v, b: F.struct(v.alias("v"), b.alias("b"))), lambda p: p["v"].isNotNull())
    none = F.array().cast("array<struct<start:int,value:string>>")

    def placed(at, block):
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), lambda s, p: F.struct(
            (s["at"] + F.length(p["b"]) + F.length(p["v"])).alias("at"),
            F.array_append(s["out"], F.struct((s["at"] + F.length(p["b"])).alias("start"), p["v"].alias("value"))).alias("out")))

    def in_blocks(p):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda k: F.slice(p, k * _BLOCK + 1, _BLOCK))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, block: _with(
            placed(s["at"], block), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], r["out"]).alias("out"))), lambda s: s["out"])

    return _with(pairs, lambda p: F.when(F.size(p) > 0, in_blocks(p)).otherwise(none))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_spans(text: Column) -> Column:
    """All spans of the plain kinds, by start, then kind."""
    return F.sort_array(F.concat(*[_spans_of(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    cue = F.contains(text, F.lit(CUES[kind])) if kind in CUES else F.lit(True)
    if kind in ("ip", "card"):
        cue = cue & text.rlike(r"[0-9][0-9.\x20-]*[0-9]")
    found = F.transform(
        F.filter(_located(text, PATTERNS[kind]), lambda x: _holds(kind, x["value"])),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    return F.when(cue, found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def entity_of(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _clear_terms(text: Column, spans: Column) -> Column:
    """(term, start, end) of each term of the whole text that no span overlaps."""
    terms = F.transform(_located(text, TERM), lambda t: F.struct(
        F.lower(t["value"]).alias("term"), t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end")))
    return F.filter(terms, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def _all_terms(text: Column) -> Column:
    """The distinct terms of a text, those in spans too."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def row_key(key: str, text: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("\x01")), whole(text)), 256)


def telling_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, open, elsewhere) of the terms that disclose an entity, from ``found`` with clear and hidden terms.

    Counts are documents, and a term counts where it stands clear of spans: terms that a document has in spans alone
    are taken off again. ``open`` are the bits left: information content of the entity less the bound of its PMI.
    """
    held = found.where("clear IS NOT NULL")
    least = Z2 / (2**GENERALISE_BITS - 1)  # fewer sights can't reach the bound, nor entities of fewer documents
    ids = held.select("row", F.explode("entities").alias("entity"))
    often = ids.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= least).select("entity")
    again = ids.join(often, "entity", "left_semi").groupBy("row").agg(F.collect_set("entity").alias("entities"))
    alike = _row_pairs(held.drop("entities").join(again, "row")).groupBy("entity", "term", "signature").agg(F.count("*").alias("n"))
    pairs = alike.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), (F.sum("n") / F.max("n")).alias("sights"))
    pairs = pairs.where(F.col("sights") >= least)
    words = docs.select(F.explode(_all_terms(whole(text))).alias("term"), F.lit(1).alias("n"))
    words = words.unionByName(held.select(F.explode("hidden").alias("term"), F.lit(-1).alias("n")))
    n_term = words.groupBy("term").agg(F.sum("n").alias("n_t"))
    share, sights = F.col("n_te") / F.col("n_t"), F.col("sights")
    low = (share + Z2 / (2 * sights) - F.sqrt(Z2 * (share * (1 - share) / sights + Z2 / (4 * sights * sights)))) / (1 + Z2 / sights)
    return n_term.join(pairs, "term").select(
        "entity", "term", (-F.log2(low)).alias("open"), (F.col("n_t") > F.col("n_te")).alias("elsewhere")).where(F.col("open") <= GENERALISE_BITS)


def _row_pairs(held: DataFrame) -> DataFrame:
    """(row, signature, entity, term). The signature is the least of a text's terms by three digests: near copies mostly
    share it, other texts hardly ever."""
    terms = F.array_distinct(F.transform("clear", lambda t: t["term"])).alias("terms")
    least = lambda k: F.array_min(F.transform(F.col("terms"), lambda t: F.xxhash64(t, F.lit(k))))
    signature = F.xxhash64(*[least(k) for k in range(3)]).alias("signature")
    rows = held.select("row", "entities", terms).select("row", "entities", "terms", signature)
    return rows.select("row", "signature", "terms", F.explode("entities").alias("entity")).select("row", "signature", "entity", F.explode("terms").alias("term"))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, base, terms) of each row: the plain spans, and all places of terms that disclose an entity.

    An entity's information content is -log2 of the share of documents that hold it; a term's PMI with it is
    log2(P(entity | term) / P(entity)), both anywhere in the document. P(entity | term) is taken at its lower
    confidence bound, so one sight or two disclose nothing, and what is left of the information content after the PMI
    doesn't depend on the number of documents. The sights of a group of copies, told by the least
    digests of a text's terms, weigh as one. In a text with the entity a term is generalised if at most ``GENERALISE_BITS`` are left and removed if at most
    ``REMOVE_BITS`` are; in a text without it, the terms that give it away are removed. Every place of such a term is in
    ``terms``. Counts cover all documents.
    Null texts are empty, without spans; repeated rows are read each; an empty table gives no rows.
    """
    body = whole(text)
    read = docs.select(F.col(key), row_key(key, text).alias("row"), body.alias("_t"), base_spans(body).alias("base"))
    read = read.withColumn("clear", F.when(F.size("base") > 0, _clear_terms(F.col("_t"), F.col("base"))))
    hidden = F.array_except(_all_terms(F.col("_t")), F.transform("clear", lambda t: t["term"]))
    entities = F.array_distinct(F.transform("base", lambda s: entity_of(s["kind"], s["value"])))
    some = F.col("clear").isNotNull()
    found = saved(read.select(key, "row", "base", "clear", F.when(some, hidden).alias("hidden"), F.when(some, entities).alias("entities")))
    telling = saved(telling_terms(docs, found, text))
    told = _row_pairs(found.where("clear IS NOT NULL")).join(telling, ["entity", "term"]).select("row", "term", "open")
    giving = saved(telling.where(F.col("elsewhere") & (F.col("open") <= REMOVE_BITS)).groupBy("term").agg(F.min("open").alias("open")))
    words = docs.select(row_key(key, text).alias("row"), F.explode(_all_terms(body)).alias("term"))
    away = saved(words.join(giving, "term").select("row", "term", "open"))
    told = told.unionByName(away).groupBy("row", "term").agg(F.min("open").alias("open"))
    plain = saved(found.where("clear IS NULL").join(away.select("row").distinct(), "row", "left_semi").select("row").distinct())
    plain = docs.select(row_key(key, text).alias("row"), body.alias("_t")).join(plain, "row", "left_semi").select(
        "row", _clear_terms(F.col("_t"), F.array().cast(SPAN)).alias("clear"))
    places = found.where("clear IS NOT NULL").select("row", "clear").unionByName(plain).select("row", F.explode_outer("clear").alias("x"))  # explode would infer a filter that places all texts' terms
    action = F.when(F.col("open") <= REMOVE_BITS, "remove").otherwise("generalise").alias("action")
    terms = places.select("row", "x.*").join(told, ["row", "term"]).select("row", "start", "end", action).groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "action"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.select(key, "row", "base").join(terms, "row", "left").select(
        key, "row", "base", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced in ``text``: ``[EMAIL]`` and so on, ``[TERM]`` for generalised terms,
    nothing for removed ones. Overlapping spans are replaced as one, by the first's mark. Texts without spans and
    null texts stay as they are; other columns, repeated rows and clashing names stay too."""
    found = find_spans(docs, key, text).select("row", "base", "terms").where((F.size("base") > 0) | (F.size("terms") > 0))
    found = found.dropDuplicates(["row"])
    parts = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(
            F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
            s["action"] == "remove", "").otherwise("[TERM]").alias("mark")))))
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col("_doc")[text]

    def step(s, p):
        inside = p["start"] < s["at"]
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.when(inside, s["out"]).otherwise(F.concat(
            s["out"], F.substr(body, s["at"] + 1, p["start"] - s["at"]), p["mark"])).alias("out"))

    clean = F.aggregate(F.col("_parts"), init, step, lambda s: F.concat(s["out"], F.substr(body, s["at"] + 1)))
    rows = docs.select(row_key(key, text).alias("_row"), packed_row(docs))
    rows = rows.join(found.select(F.col("row").alias("_row"), parts.alias("_parts")), "_row", "left")
    return rows.select(*unpacked(docs, **{text: F.when(F.col("_parts").isNull(), body).otherwise(clean)}))



def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        key,
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.concat(plain, terms)), name), ",").alias("spans"))
