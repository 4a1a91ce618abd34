"""Scoring: keyed gold/prediction match, hallucinations, span schemas, overlap, MLM buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.labels import bind
from glossmark.functions.numeric import cosine, f1_score, ratio
from glossmark.functions.text import nfkc_casefold
from glossmark.operators.ordering import first_per_key, linear_percentiles, meet_per_code
from glossmark.operators.tokens import edges_of, row_slices

SYSTEM_SIMILARITY = 0.8
KEY = ["codigo", "pactivo_key", "reacadv_key"]


def evaluation_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_key`` in evaluation form.

    A NULL cell becomes the text 'nan', as a missing value does when printed.
    Apply it to dimension rows before they are joined to facts where possible.
    """
    for column in columns:
        text = F.coalesce(F.col(column), F.lit("nan"))
        rows = rows.withColumn(f"{column}_key", nfkc_casefold(text))
    return rows


def frequency_agrees(gold: Column, predicted: Column) -> Column:
    """Either value contains the other; '' is contained in everything."""
    return F.contains(gold, predicted) | F.contains(predicted, gold)


def frequency_equal(gold: Column, predicted: Column) -> Column:
    """Strict variant of ``frequency_agrees``."""
    return gold == predicted


def _meet(gold: DataFrame, predictions: DataFrame, order: list[str], vectors: DataFrame | None, how: str) -> DataFrame:
    """Counted gold cells against the first prediction of each key, with the three agreement flags."""
    cells = gold.groupBy(*KEY, "frecuencia_key", "sistema_key").agg(F.count("*").alias("n"))
    firsts = first_per_key(
        predictions.select(*KEY, "frecuencia_key", "sistema_key", *order), KEY, order
    ).select(
        *KEY,
        F.col("frecuencia_key").alias("_freq"),
        F.col("sistema_key").alias("_sys"),
        F.lit(True).alias("_hit"),
    )
    joined = cells.join(firsts, KEY, how)
    same = F.col("sistema_key") == F.col("_sys")
    if vectors is not None:
        a = vectors.select(F.col("text").alias("sistema_key"), F.col("vector").alias("_va"))
        b = vectors.select(F.col("text").alias("_sys"), F.col("vector").alias("_vb"))
        joined = joined.join(a, "sistema_key", "left").join(b, "_sys", "left")
        near = (F.col("sistema_key") != "") & (F.col("_sys") != "") & (
            cosine(F.col("_va"), F.col("_vb")) >= SYSTEM_SIMILARITY
        )
        same = same | F.coalesce(near, F.lit(False))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(
        *KEY,
        "n",
        hit.alias("matched"),
        (hit & frequency_agrees(F.col("frecuencia_key"), F.col("_freq"))).alias("frequency_ok"),
        (hit & same).alias("system_ok"),
    )


def match_gold(
    gold: DataFrame,
    predictions: DataFrame,
    order: list[str],
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Gold cells with their match, many to one: the first prediction of a key serves all gold rows.

    Both sides carry KEY, ``frecuencia_key`` and ``sistema_key``. Gold rows with
    equal cells are counted before the join, so a hot key is one row. ``vectors``
    (text, vector) adds the similarity check to unequal systems.

    Returns KEY, n, matched, frequency_ok, system_ok.
    """
    return _meet(gold, predictions, order, vectors, "left")


def hallucinations(gold: DataFrame, predictions: DataFrame, order: list[str]) -> DataFrame:
    """First prediction of every key that no gold row of the same code has; codes without gold aren't scored."""
    invented = first_per_key(predictions.join(gold.select(*KEY).distinct(), KEY, "left_anti"), KEY, order)
    return meet_per_code(invented, gold.select("codigo").distinct(), "codigo", KEY[1:], "left_semi")


def _sum_if(flag: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0))


def code_scores(gold: DataFrame, predictions: DataFrame, order: list[str], vectors=None) -> DataFrame:
    """Per code: gold rows, prediction rows, matches, field agreement, hallucinations, file flag.

    One full outer join gives both directions: keys without gold are the
    hallucinations of a code. Codes without gold are not scored.
    """
    met = _meet(gold, predictions, order, vectors, "full")
    gold_side = met.groupBy("codigo").agg(
        F.sum("n").alias("gold_rows"),
        _sum_if("matched").alias("matched"),
        _sum_if("frequency_ok").alias("frequency_ok"),
        _sum_if("system_ok").alias("system_ok"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("hallucinated"),
    ).where(F.col("gold_rows").isNotNull())
    predicted = predictions.groupBy("codigo").agg(F.count("*").alias("predicted_rows"))
    return gold_side.join(predicted, "codigo", "left").select(
        "codigo",
        "gold_rows",
        F.coalesce("predicted_rows", F.lit(0).cast("long")).alias("predicted_rows"),
        "matched",
        "frequency_ok",
        "system_ok",
        "hallucinated",
        F.col("predicted_rows").isNull().alias("file_missing"),
    )


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """One row: totals and the detection rate in percent."""
    gold, matched = F.sum("gold_rows"), F.sum("matched")
    return scores.agg(
        F.count("*").alias("total_codes"),
        F.sum(F.col("file_missing").cast("long")).alias("missing_files"),
        gold.alias("gold_rows"),
        F.sum("predicted_rows").alias("predicted_rows"),
        matched.alias("matched"),
        F.bround(ratio(matched * 100, gold), 2).alias("detection_rate"),
    )


def tag_scores(scores: DataFrame) -> DataFrame:
    """Counts and P/R/F1 per tag and overall; invented predictions are spurious for REACADV only."""
    tags = F.array(*[
        F.struct(
            F.lit(tag).alias("tag"),
            F.col(good).alias("correct"),
            (F.col("gold_rows") - F.col(good)).alias("missed"),
            extra.alias("spurious"),
        )
        for tag, good, extra in (
            ("REACADV", "matched", F.col("hallucinated")),
            ("FRECUENCIA", "frequency_ok", F.lit(0).cast("long")),
            ("SISTEMA", "system_ok", F.lit(0).cast("long")),
        )
    ])
    long = scores.select(F.explode(tags).alias("t")).select("t.*")
    counted = long.groupingSets([["tag"], []], "tag").agg(
        F.sum("correct").alias("correct"),
        F.sum("missed").alias("missed"),
        F.sum("spurious").alias("spurious"),
    )
    return with_prf(
        counted.withColumn("tag", F.coalesce("tag", F.lit("overall"))),
        F.col("correct"),
        F.col("correct") + F.col("spurious"),
        F.col("correct") + F.col("missed"),
    )


def with_prf(rows: DataFrame, good: Column, actual: Column, possible: Column, digits: int = 4) -> DataFrame:
    """Add precision, recall and f1, rounded half-even."""
    precision, recall = ratio(good, actual), ratio(good, possible)
    return rows.select(
        "*",
        F.bround(precision, digits).alias("precision"),
        F.bround(recall, digits).alias("recall"),
        F.bround(f1_score(precision, recall), digits).alias("f1"),
    )


# --- spans -------------------------------------------------------------------

SCHEMAS = ("strict", "exact", "partial", "ent_type")


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def pair_spans(gold: Column, predicted: Column) -> Column:
    """How each predicted span of a sentence relates to the gold: array<struct<tag,kind>>.

    Identical spans pair first; the others, in text order, take the first free
    gold span they overlap. Kinds: same, bounds (other type), type (shared type,
    other bounds), touch (overlap only), spurious. Free gold spans are missed.
    """
    def step(state: Column, p: Column) -> Column:
        at = F.array_position(
            F.transform(state["free"], lambda g: _overlap(g, p)), F.lit(True)
        )
        g = F.get(state["free"], (at - 1).cast("int"))
        bounds = (g["start"] == p["start"]) & (g["end"] == p["end"])
        kind = (
            F.when(at == 0, F.lit("spurious"))
            .when(bounds, F.lit("bounds"))
            .when(g["tag"] == p["tag"], F.lit("type"))
            .otherwise(F.lit("touch"))
        )
        rest = F.when(at == 0, state["free"]).otherwise(
            F.filter(state["free"], lambda x, i: i != at - 1)
        )
        out = F.concat(state["out"], F.array(F.struct(p["tag"].alias("tag"), kind.alias("kind"))))
        return F.struct(rest.alias("free"), out.alias("out"))

    def tagged(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["tag"].alias("tag"), F.lit(kind).alias("kind")))

    def pair(sides: Column) -> Column:
        same = F.array_intersect(sides["g"], sides["p"])
        start = F.struct(
            F.array_except(sides["g"], same).alias("free"), tagged(same, "same").alias("out")
        )
        return F.aggregate(
            F.array_except(sides["p"], same),
            start,
            step,
            lambda s: F.concat(s["out"], tagged(s["free"], "missed")),
        )

    return bind(F.struct(gold.alias("g"), predicted.alias("p")), pair)


def overlap_islands(sentences: DataFrame, keys: list[str], gold: str, predicted: str) -> DataFrame:
    """Cut each sentence into islands of touching spans: one row per island, same two span arrays.

    Spans of different islands never meet, so every span comparison below is
    made inside an island, however long a sentence is. Islands are cut inside the
    sentence's row: no span is shuffled.
    """
    kind = sentences.schema[gold].dataType.simpleString()

    @F.arrow_udf(f"array<struct<gold:{kind},pred:{kind}>>")
    def cut(golds: pa.Array, preds: pa.Array) -> pa.Array:
        missing = pc.or_(golds.is_null(), preds.is_null())  # no filter before: it would compute the spans twice
        golds, preds = (pc.if_else(missing, pa.scalar(None, side.type), side) for side in (golds, preds))
        sizes = np.diff(edges_of(golds)) + np.diff(edges_of(preds))
        out = [_islands(golds[rows], preds[rows]) for rows in row_slices(sizes)]
        return pa.concat_arrays(out) if out else _islands(golds, preds)

    return sentences.select(*keys, F.explode(cut(F.col(gold), F.col(predicted))).alias("_i")).select(
        *keys, F.col("_i.gold").alias(gold), F.col("_i.pred").alias(predicted))


def _islands(golds: pa.ListArray, preds: pa.ListArray) -> pa.ListArray:
    """The islands of each row: gold and predicted spans, each in order of start, end and tag."""
    spans, rows, starts, ends = [], [], [], []
    for side in (golds, preds):
        flat, row = side.flatten(), np.repeat(np.arange(len(side)), np.diff(edges_of(side)))
        start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        order = np.lexsort((pc.rank(flat.field("tag"), tiebreaker="dense").to_numpy(), end, start, row))
        spans.append(flat.take(pa.array(order)))
        rows.append(row[order])
        starts.append(start[order])
        ends.append(end[order])
    row, start, end = map(np.concatenate, (rows, starts, ends))
    order = np.lexsort((end, start, row))
    # the row stands above the place, so that the furthest end of earlier rows is before every start of a row
    first, last = (row[order] << 32) + start[order], np.maximum.accumulate((row[order] << 32) + end[order])
    opens = np.concatenate([np.ones(min(len(first), 1), bool), first[1:] >= last[:-1]])
    island = np.empty(len(row), np.int64)
    island[order] = np.cumsum(opens) - 1
    n = int(opens.sum())
    sides = np.split(island, [len(rows[0])])
    lists = [
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32()), flat)
        for of, flat in zip(sides, spans, strict=True)]
    per_row = np.bincount(row[order][opens], minlength=len(golds))
    cells = pa.StructArray.from_arrays(lists, names=["gold", "pred"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), cells)


def span_schema_scores(sentences: DataFrame, gold: str, predicted: str) -> DataFrame:
    """COR/INC/PAR/MIS/SPU, P, R, F1 for the four schemas, per tag and overall.

    Input is one row per sentence or island with two span arrays. Pairing is
    row-local; only (tag, kind) counts are shuffled.
    """
    kinds = (
        sentences.select(F.explode(pair_spans(F.col(gold), F.col(predicted))).alias("r"))
        .select("r.tag", "r.kind")
        .groupBy("tag", "kind")
        .agg(F.count("*").alias("n"))
    )
    # For each schema: what a kind counts as.
    outcome = {
        "strict": {"same": "correct", "bounds": "incorrect", "type": "incorrect", "touch": "incorrect"},
        "exact": {"same": "correct", "bounds": "correct", "type": "incorrect", "touch": "incorrect"},
        "partial": {"same": "correct", "bounds": "correct", "type": "partial", "touch": "partial"},
        "ent_type": {"same": "correct", "bounds": "incorrect", "type": "correct", "touch": "incorrect"},
    }
    cells = F.array(*[
        F.struct(
            F.lit(schema).alias("schema"),
            F.coalesce(
                *[F.when(F.col("kind") == k, F.lit(v)) for k, v in outcome[schema].items()], F.col("kind")
            ).alias("outcome"),
        )
        for schema in SCHEMAS
    ])
    long = kinds.select("tag", "n", F.explode(cells).alias("c")).select("tag", "n", "c.*")

    def count_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).alias(name)

    counted = long.groupingSets([["schema", "tag"], ["schema"]], "schema", "tag").agg(
        *[count_of(k) for k in ("correct", "incorrect", "partial", "missed", "spurious")]
    ).withColumn("tag", F.coalesce("tag", F.lit("overall")))
    half = F.when(F.col("schema").isin("partial", "ent_type"), F.lit(0.5)).otherwise(F.lit(0.0))
    seen = F.col("correct") + F.col("incorrect") + F.col("partial")
    return with_prf(
        counted,
        F.col("correct") + half * F.col("partial"),
        seen + F.col("spurious"),
        seen + F.col("missed"),
    )


def loose_overlap(sentences: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per tag: a span counts when any span of the same tag on the other side overlaps it."""

    def flagged(own: str, other: str, side: str) -> Column:
        return F.transform(
            F.col(own),
            lambda s: F.struct(
                s["tag"].alias("tag"),
                F.lit(side).alias("side"),
                F.exists(F.col(other), lambda o: (o["tag"] == s["tag"]) & _overlap(o, s)).alias("hit"),
            ),
        )

    both = F.concat(flagged(gold, predicted, "gold"), flagged(predicted, gold, "pred"))
    rows = sentences.select(F.explode(both).alias("s")).select("s.*")

    def total(side: str, hit: bool = False) -> Column:
        test = (F.col("side") == side) & (F.col("hit") if hit else F.lit(True))
        return F.count(F.when(test, 1))

    counted = rows.groupBy("tag").agg(
        total("pred", True).alias("matched_pred"),
        total("gold", True).alias("matched_gold"),
        total("pred").alias("pred"),
        total("gold").alias("gold"),
    )
    precision = ratio(F.col("matched_pred"), F.col("pred"))
    recall = ratio(F.col("matched_gold"), F.col("gold"))
    return counted.select(
        "tag", "matched_pred", "matched_gold", "pred", "gold",
        F.bround(precision, 4).alias("precision"),
        F.bround(recall, 4).alias("recall"),
        F.bround(f1_score(precision, recall), 4).alias("f1"),
    )


def entity_counts(sentences: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per tag: support (gold spans), predicted spans, exact hits."""
    def tagged(spans: Column, side: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["tag"].alias("tag"), F.lit(side).alias("side")))

    cells = F.concat(
        tagged(F.col(gold), "gold"),
        tagged(F.col(predicted), "pred"),
        tagged(F.array_intersect(gold, predicted), "both"),
    )
    rows = sentences.select(F.explode(cells).alias("s")).select("s.*")
    return rows.groupBy("tag").agg(
        F.count(F.when(F.col("side") == "gold", 1)).alias("support"),
        F.count(F.when(F.col("side") == "pred", 1)).alias("predicted"),
        F.count(F.when(F.col("side") == "both", 1)).alias("correct"),
    )


def label_hits(sentences: DataFrame, gold: str, predicted: str) -> DataFrame:
    """What ``entity_counts`` gives over the spans of two label columns, from the labels themselves.

    Spans are cut and compared over the flat labels of an Arrow batch, and a task gives a row per tag and batch; no span
    becomes a row.
    """
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                tags: dict[str, int] = {}
                (row, start, end, tag), (row2, start2, end2, tag2) = (_flat_spans(c, tags) for c in whole.slice(at, 4096).columns)
                width = int(max(start.max(initial=0), start2.max(initial=0))) + 1
                _, i, j = np.intersect1d(row * width + start, row2 * width + start2, assume_unique=True, return_indices=True)
                hit = tag[i][(end[i] == end2[j]) & (tag[i] == tag2[j])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(tags), pa.string()), *(pa.array(np.bincount(x, minlength=len(tags)), pa.int64()) for x in (tag, tag2, hit))],
                    names=["tag", "support", "predicted", "correct"])

    counted = sentences.select(gold, predicted).mapInArrow(run, "tag string, support long, predicted long, correct long")
    return counted.groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "correct")]).where("support + predicted > 0")


def _flat_spans(labels: pa.ListArray, tags: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and number of the tag of each span, by the rule of ``label_spans``; new tags get the next number."""
    edges, flat = edges_of(labels), labels.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    codes = flat.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    tag = np.array([*(-1 if x == "O" else tags.setdefault(x[2:], len(tags)) for x in names), -1], np.int64)[codes]
    opens = (tag < 0) | np.array([*(x.startswith("B-") for x in names), True])[codes]
    opens[1:] |= tag[1:] != tag[:-1]
    opens[edges[:-1][edges[:-1] < edges[1:]]] = True
    at = np.flatnonzero(opens)
    end, real = np.append(at[1:], len(tag)), tag[at] >= 0
    row = np.searchsorted(edges, at, "right") - 1
    return row[real], (at - edges[row])[real], (end - edges[row])[real], tag[at][real]


def averaged_scores(counts: DataFrame) -> DataFrame:
    """Per-tag P/R/F1 with micro, macro and weighted averages, and support."""
    precision = ratio(F.col("correct"), F.col("predicted"))
    recall = ratio(F.col("correct"), F.col("support"))
    per_tag = counts.select(
        "tag", "support", "predicted", "correct",
        precision.alias("precision"), recall.alias("recall"),
        f1_score(precision, recall).alias("f1"),
    )
    micro_p = ratio(F.sum("correct"), F.sum("predicted"))
    micro_r = ratio(F.sum("correct"), F.sum("support"))

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    averages = per_tag.agg(
        F.array(
            F.struct(F.lit("micro avg").alias("tag"), micro_p.alias("precision"), micro_r.alias("recall"),
                     f1_score(micro_p, micro_r).alias("f1")),
            F.struct(F.lit("macro avg").alias("tag"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1")),
            F.struct(F.lit("weighted avg").alias("tag"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1")),
        ).alias("rows"),
        F.sum("support").alias("support"),
    ).select(F.explode("rows").alias("r"), "support")
    columns = ["precision", "recall", "f1"]
    lines = per_tag.select("tag", "support", *columns).unionByName(
        averages.select("r.tag", "support", *[f"r.{c}" for c in columns])
    )
    return lines.select("tag", "support", *[F.bround(c, 4).alias(c) for c in columns])


# --- masked language model ----------------------------------------------------


def mlm_buckets(positions: DataFrame, category: str = "category") -> DataFrame:
    """Per category and overall: masked tokens, cross-entropy, pseudo-perplexity, top-1, top-5.

    Losses are summed as decimals, so the result does not depend on task order.
    """
    exact = F.sum(F.col("loss").cast("decimal(28,10)"))
    grouped = positions.groupingSets([[category], []], category).agg(
        F.count("*").alias("n_masked"),
        exact.alias("_loss"),
        F.count(F.when(F.col("top1"), 1)).alias("_top1"),
        F.count(F.when(F.col("top5"), 1)).alias("_top5"),
    )
    loss = F.col("_loss").cast("double") / F.col("n_masked")
    return grouped.select(
        F.coalesce(category, F.lit("overall")).alias(category),
        "n_masked",
        F.bround(loss, 6).alias("cross_entropy"),
        F.bround(F.exp(loss), 6).alias("pseudo_perplexity"),
        F.bround(F.col("_top1") / F.col("n_masked"), 6).alias("top1_accuracy"),
        F.bround(F.col("_top5") / F.col("n_masked"), 6).alias("top5_accuracy"),
    )


def document_losses(positions: DataFrame, key: str) -> DataFrame:
    """Distribution of the mean loss per document, with linear quartiles."""
    means = positions.groupBy(key).agg(
        (F.sum(F.col("loss").cast("decimal(28,10)")).cast("double") / F.count("*")).alias("mean_loss")
    )
    shares = {"min_loss": 0.0, "p25_loss": 0.25, "median_loss": 0.5, "p75_loss": 0.75, "max_loss": 1.0}
    ranks = linear_percentiles(means, "mean_loss", shares)
    return ranks.select(
        F.col("n").alias("n_documents"),
        F.bround("mean", 6).alias("mean_loss"),
        *[F.bround(name, 6).alias(name) for name in shares],
    )
