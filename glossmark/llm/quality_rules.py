"""Quality classifier: a sparse ensemble of rules read off tree paths, weighed by lasso logistic regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import WORD, crc_remainder, packed_row, saved, unpacked, whole, word_count, words_of

#: Labelled rows that trees and weights are fitted on, at most (about; by digest of the key).
FIT_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 11
#: Lasso strength.
PENALTY = 0.0005
#: Scores from here on are predicted 1.
CUT = 0.3


def text_statistics(text: Column) -> dict[str, Column]:
    """What rules may ask of a text: counts and shares, all from the text alone."""
    words = word_count(text).cast("double")
    chars = F.greatest(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(1)).cast("double")
    per = lambda n: n.cast("double") / F.greatest(words, F.lit(1.0))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double") / chars
    bare = words_of(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "words": words,
        "word_length": chars / F.greatest(words, F.lit(1.0)),
        "symbols": share(r"[#*$%&|<>]"),
        "marks": share(r"[!?]"),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "stops": share(r"[.,;:]"),
        "other": share(r"[^\p{L}\p{N}.,;:!?\x20\x09-\x0D]"),
        "forms": per(F.size(F.array_distinct(bare))),
        "repeats": per(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))"))),
        "short": per(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])"))),
        "lines": per(F.size(lines)),
        "same_lines": F.size(F.array_distinct(lines)).cast("double") / F.greatest(F.size(lines), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.bound if self.above else value <= self.bound


Rule = tuple[Condition, ...]


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Every path from a root to a node, as its conditions; each once, in a set order."""
    found: set[Rule] = set()

    def walk(node, path: Rule) -> None:
        if path:
            found.add(_tight(path))
        if node.subtreeDepth() > 0:
            split = node.split()
            name, bound = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, Condition(name, False, bound)))
            walk(node.rightChild(), (*path, Condition(name, True, bound)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return sorted(found, key=lambda r: [(c.statistic, c.above, c.bound) for c in r])


def _tight(path: Rule) -> Rule:
    """One condition for each statistic and side: the narrowest."""
    best: dict[tuple[str, bool], float] = {}
    for c in path:
        at = (c.statistic, c.above)
        best[at] = c.bound if at not in best else max(best[at], c.bound) if c.above else min(best[at], c.bound)
    return tuple(Condition(s, a, b) for (s, a), b in sorted(best.items()))


def rule_column(rule: Rule) -> Column:
    held = rule[0].column()
    for condition in rule[1:]:
        held = held & condition.column()
    return held


@dataclass(frozen=True)
class RuleModel:
    """An intercept, and the rules with a weight other than zero."""
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """P(label 1) as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(rows: DataFrame, names: list[str], label: str = "label") -> RuleModel:
    """Rules from a forest over ``rows`` (statistics and a label of 0 or 1), weighed by lasso logistic regression.

    Without rows, or with one label only, the model is that label's rate, smoothed.
    """
    counted = rows.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    n, ones = counted["n"], counted["ones"] or 0
    rate = (ones + 1.0) / (n + 2.0)
    flat = RuleModel(math.log(rate / (1 - rate)), ())
    if not 0 < ones < n:
        return flat
    stats = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*names)).alias("features"), *names)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5)
    rules = tree_rules(forest.fit(stats.select("label", "features")), names)
    if not rules:
        return flat
    flags = F.array(*[rule_column(r).cast("double") for r in rules])
    held = stats.select("label", array_to_vector(flags).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False)
    fitted = lasso.fit(held)
    held.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleModel(float(fitted.intercept), tuple(weights))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 5, cut: float = CUT,
) -> DataFrame:
    """(key, held_out, score, predicted) of each row's whole text.

    Labels are learnt only from rows whose crc32(key as text) mod ``folds`` isn't 0; the rest are held out. Statistics are
    computed once for all texts; trees and weights are fitted on at most about ``FIT_ROWS`` labelled rows, chosen by
    digest; every row is scored by the compiled rules. Null and empty texts have statistics 0 and get a score; null
    labels and labels of unknown keys teach nothing; repeated rows are scored each; without labels every score is
    0.5; an empty table gives no rows.
    """
    model, measured = learnt(docs, labels, key, text, label, folds)
    held_out = crc_remainder(key, folds) == 0
    score = model.score()
    return measured.select(key, held_out.alias("held_out"), score.alias("score")).select(
        key, "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def learnt(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5,
) -> tuple[RuleModel, DataFrame]:
    """The model, and the statistics of every row with its key."""
    stats = text_statistics(whole(text))
    measured = saved(docs.select(F.col(key), *[c.alias(n) for n, c in stats.items()]))
    return _fitted(measured, labels, key, label, folds), measured


def _fitted(measured: DataFrame, labels: DataFrame, key: str, label: str, folds: int) -> RuleModel:
    """The model of labelled rows of ``measured`` (key, statistics)."""
    names = [c for c in measured.columns if c != key]
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("double").alias("label"))
    taught = measured.where(crc_remainder(key, folds) != 0).join(known, key)
    share = min(1.0, FIT_ROWS / max(known.count(), 1))
    chosen = taught.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return fit_rules(saved(chosen.select("label", *names)), names)


def accepted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, cut: float = CUT,
) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all rows and columns as in ``classify``.

    Rows and statistics are written once, so that no rule computes a statistic again; the model learns from the written
    statistics and filters the written rows.
    """
    stats = text_statistics(whole(text))
    measured = saved(docs.select(packed_row(docs), *[c.alias(n) for n, c in stats.items()]))
    model = _fitted(measured.select(F.col("_doc")[key].alias(key), *stats), labels, key, label, folds)
    return measured.where(model.score() >= cut).select(*unpacked(docs))
