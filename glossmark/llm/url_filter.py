"""URL filter: host and path rules, then the ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import ascii_lower, crc_remainder
from glossmark.session import checkpointed

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Characters of context at most.
ORDER = 5
#: Weight of the shorter context's estimate against the counts of the longer one.
STRENGTH = 4.0
#: Character values that the uniform estimate under the shortest context spreads over.
ALPHABET = 256.0
#: Cells of the calibration histogram and their width in nats per character.
CELLS, WIDTH = 400, 0.02


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: a struct of verdict and rule, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def _grams(rows: DataFrame, order: int, *keep: str) -> DataFrame:
    """Each character of ``url`` with up to ``order`` characters before it, as one gram; short at the start."""
    at = F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at")
    spread = rows.where(F.length("url") > 0).select(*keep, "url", at)
    first = F.greatest(F.col("at") - order, F.lit(1))
    return spread.select(*keep, F.substr("url", first, F.col("at") - first + 1).alias("gram"))


def gram_ratios(training: DataFrame, wanted: DataFrame, order: int, strength: float) -> DataFrame:
    """(gram, ratio): log P(last | before) of the accepted minus that of the rejected, for each wanted gram.

    ``training`` has url and accepted. Counts are variable-order: a gram of length k + 1 is a context of k
    characters and the character after it. P at length k blends the counts under that context with P at k - 1
    by the weight ``strength``; an unseen context leaves the shorter estimate. Every wanted gram is
    estimated once.
    """
    sides = ("a", "r")
    long = _grams(training, order, "accepted").groupBy("gram").agg(
        F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    tails = long.select("a", "r", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))).alias("gram"))
    counts = tails.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counts = checkpointed(counts)
    context = F.left("gram", F.length("gram") - 1)
    totals = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
    # every tail of a wanted gram with its counts and its context's, then one fold from short to long; contexts are
    # looked up once for each distinct tail, so that the empty one meets a row per character
    tails = wanted.select("gram", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))).alias("tail"))
    numbers = (
        tails.select("tail").distinct().join(counts.withColumnRenamed("gram", "tail"), "tail", "left")
        .withColumn("context", F.left("tail", F.length("tail") - 1)).join(totals, "context", "left")
        .select("tail", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("a", "ta", "r", "tr")])
    )
    steps = (
        tails.join(numbers, "tail")
        .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(F.length("tail").alias("k"), "a", "ta", "r", "tr"))).alias("steps"))
    )

    def estimate(side):
        return F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda p, s: (s[side] + strength * p) / (s["t" + side] + strength))

    a, r = (estimate(side) for side in sides)
    return steps.select("gram", (F.log(a) - F.log(r)).alias("ratio"))


def _threshold(scores: DataFrame) -> float:
    """The score that splits known accepted from known rejected with the least balanced error.

    ``scores`` has score and accepted. Read from a histogram of fixed cells (400 rows at most); halfway between
    the two best cells' borders where several are equal. 0 if one side is missing.
    """
    cell = F.greatest(F.lit(-CELLS // 2), F.least(F.lit(CELLS // 2), F.floor(F.col("score") / WIDTH))).cast("int")
    rows = scores.groupBy(cell.alias("cell")).agg(
        F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r")).collect()
    all_a, all_r = sum(x["a"] for x in rows), sum(x["r"] for x in rows)
    if not all_a or not all_r:
        return 0.0
    by, best, below_a, below_r = {x["cell"]: x for x in rows}, [], 0, 0
    for c in range(-CELLS // 2, CELLS // 2 + 2):  # cells under c are blocked
        best.append((below_a / all_a + 1 - below_r / all_r, c))
        below_a += by[c]["a"] if c in by else 0
        below_r += by[c]["r"] if c in by else 0
    least = min(error for error, _ in best)
    equal = [c for error, c in best if error <= least + 1e-12]
    return WIDTH * (equal[0] + equal[-1]) / 2


def judge_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER, strength: float = STRENGTH,
) -> DataFrame:
    """Host, path, rule, verdict and score of each row's url.

    The rules' verdicts stand. They also label the training urls: two models, of allowed and of blocked ones, give
    each other url the mean log ratio of its characters; it is allowed at or above a threshold calibrated on a
    fifth of the labelled urls (by crc32 of the key), which the models that calibrate don't see. Null urls and urls
    without ``://`` have an empty host and path; an empty url scores 0. Without urls of both labels all ratios are
    0 and the threshold is 0: allow. Repeated rows are judged each; an empty table gives no rows.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(text), path_of(text)
    rows = pages.select(F.col(key), text.alias("url"), host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("by"))
    rows = rows.withColumn("aside", crc_remainder(key, 5) == 0)
    urls = checkpointed(rows.groupBy("url").agg(
        F.first("by.verdict").alias("verdict"), F.max("aside").alias("aside")))
    known = urls.where("verdict IS NOT NULL").select("url", "aside", (F.col("verdict") == "allow").alias("accepted"))

    def scored(of: DataFrame, training: DataFrame) -> DataFrame:
        grams = _grams(of.select("url").distinct(), order, "url").groupBy("url", "gram").agg(F.count("*").alias("n"))
        ratios = gram_ratios(training, grams.select("gram").distinct(), order, strength)
        return grams.join(ratios, "gram").groupBy("url").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))

    def both(training: DataFrame) -> bool:
        return len(training.select("accepted").distinct().take(2)) == 2

    apart = known.where("NOT aside")
    threshold = _threshold(
        scored(known.where("aside"), apart).join(known, "url")) if both(apart) else 0.0
    judged = urls.where("verdict IS NULL")
    scores = scored(judged, known) if both(known) else judged.select("url", F.lit(0.0).alias("score"))
    score = F.round(F.coalesce("score", F.lit(0.0)), 12)
    return rows.join(scores, "url", "left").select(
        key, "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(score >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("by").isNull(), score).alias("score"))
