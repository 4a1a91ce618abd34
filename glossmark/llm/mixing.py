"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within source, prefix-summed to budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import packed_row, unpacked, whole, word_count
from glossmark.session import checkpointed

#: Key ranges of a source whose sizes are summed before one range is ordered.
RANGES = 4096


def sample_key(key: str, quality: Column, seed: str) -> Column:
    """An exponential variate with the quality as its rate, drawn from a digest of seed and key: smallest first."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(uniform) / quality


def text_quality(text: str = "text") -> Column:
    """A weight between 0 and 1: falls with the share of symbols among the words."""
    symbols = F.regexp_count(whole(text), F.lit(r"[#*$%&|<>]")).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * symbols / F.greatest(word_count(whole(text)), F.lit(1)))


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], limit: float) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, filled up to ``limit`` times the size.

    Sources in code point order, null last, weigh ``weights`` in turn. What a full source can't take goes to
    the others by weight; the level at which that ends is the first at which the next source (by size over
    weight) isn't full. There is one row per source, so one task orders them.
    """
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
        .withColumn("rank", F.row_number().over(fill))
        .withColumn("full_before", F.coalesce(
            F.sum(limit * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_after", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_after"))
        .withColumn("found", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("rank", "level"))).over(Window.partitionBy()))
    )
    full = limit * F.col("source_size")
    return rows.select("source", "source_size", F.least(full, F.coalesce(F.col("found.level") * F.col("weight"), full)).alias("target"))


def mixing_cuts(sized: DataFrame, share: float, weights: tuple[int, ...], limit: float) -> DataFrame:
    """One row per source: its target, complete epochs, and where the fractional selection ends.

    ``sized`` has key, source, size and e (the sample key). No source is ordered whole: sizes are summed by
    key range first, then only the range in which the budget ends is ordered, a 4,096th of the source.
    Rows equal in (e, key, size) share what is left evenly.
    """
    in_range = F.floor((F.lit(1.0) - F.exp(-F.col("e"))) * RANGES).cast("int")
    ranged = sized.withColumn("part", in_range)
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("size"))
    targets = source_targets(
        parts.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, limit)
    budget, size = F.round("target").cast("long"), F.col("source_size")
    targets = targets.withColumns({
        "epochs": F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("long"),
        "rest": F.when(size > 0, budget % size).otherwise(0).cast("long"),
    })
    before = F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")
    t, p = targets.alias("t"), parts.withColumn("before", before).alias("p")
    ends = (
        t.join(p, F.col("t.source").eqNullSafe(F.col("p.source")))
        .where((F.col("rest") > 0) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("p.size")))
        .select(F.col("t.source").alias("source"), "part", (F.col("rest") - F.col("before")).alias("rest"))
    )
    r, c = ranged.alias("r"), ends.alias("c")
    last = (
        r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.part") == F.col("c.part")))
        .groupBy(F.col("r.source").alias("source"), "e", "key", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    )
    ordered = Window.partitionBy("source").orderBy("e", "key", "size")
    cut = (
        last.withColumn("before", F.sum(F.col("n") * F.col("size")).over(ordered) - F.col("n") * F.col("size"))
        .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n") * F.col("size")))
        .select("source", F.struct("e", "key", "size").alias("cut"),
                F.floor((F.col("rest") - F.col("before")) / F.col("n")).cast("long").alias("cut_words"))
    )
    t, c = targets.alias("t"), cut.alias("c")
    return t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", "c.cut", "c.cut_words")


def _decided(
    docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), limit: float = 2.0, seed: str = "mix",
    key: str = "doc_id", source: str = "source", text: str = "text", quality: Column | None = None, whole_rows: bool = False,
) -> DataFrame:
    """(_row, _mix) of each row, with _doc where whole rows are asked for; else the sizes are read once."""
    rate = text_quality(text) if quality is None else quality
    row = F.struct(F.col(key).alias("key"), F.col(source).alias("source"), word_count(whole(text)).alias("size"),
                   sample_key(key, rate, seed).alias("e")).alias("_row")
    sized = checkpointed(docs.select(row))
    cuts = checkpointed(mixing_cuts(sized.select("_row.*"), share, weights, limit))
    rows = docs.select(row, packed_row(docs)) if whole_rows else sized
    c = cuts.select(F.struct(*cuts.columns).alias("_cut"))
    at = F.struct("_row.e", "_row.key", "_row.size")
    inside, on = at < F.col("_cut.cut"), at == F.col("_cut.cut")
    taken = F.when(F.col("_cut.cut").isNull(), 0).when(inside, F.col("_row.size")).when(on, F.col("_cut.cut_words")).otherwise(0)
    more = F.when(F.col("_cut.cut").isNull(), False).when(inside, True).otherwise(on & (2 * F.col("_cut.cut_words") >= F.col("_row.size")))
    return rows.join(c, F.col("_row.source").eqNullSafe(F.col("_cut.source"))).withColumn("_mix", F.struct(
        (F.col("_cut.epochs") * F.col("_row.size") + taken.cast("long")).alias("taken"),
        (F.col("_cut.epochs") + more.cast("long")).alias("copies")))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies) of each row; taken counts words, repeats too.

    A source's target is met to the word: complete epochs first, then whole documents in the order of their
    sample keys, then the first words of one more. ``copies`` counts whole rows: the document at the cut has one
    more if at least half of it is taken. Null or empty texts have size 0 and take 0 words; null sources
    are one source, last in order; repeated rows count each; an empty table gives no rows.
    """
    names = settings.get("key", "doc_id"), settings.get("source", "source")
    return _decided(docs, **settings).select(
        F.col("_row.key").alias(names[0]), F.col("_row.source").alias(names[1]), "_row.size", "_cut.source_size", "_cut.target",
        "_mix.taken", "_mix.copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    rows = _decided(docs, **settings, whole_rows=True).where("_mix.copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies"))).alias("_copy")
    return rows.select("_doc", times).select(*unpacked(docs))
