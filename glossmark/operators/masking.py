"""Masked-corpus build: vocabulary, word categories, window fill, whole-word masks."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glossmark.functions.keys import seeded_hash
from glossmark.functions.text import nfkc_casefold
from glossmark.operators.tokens import edges_of, in_rows, running_offsets

#: Letters of a vocabulary word.
LETTERS = "a-záéíóúñü"
# Closed-class words left out of the vocabulary.
STOP_WORDS = (
    "el", "la", "los", "las", "un", "una", "unos", "unas", "lo", "de", "a", "en", "con", "por", "para", "sin", "sobre", "hasta", "desde", "entre", "hacia", "contra",
    "ante", "bajo", "durante", "mediante", "según", "tras", "y", "o", "e", "u", "pero", "sino", "ni", "que", "porque", "pues", "si", "aunque", "mientras",
    "cuando", "como", "yo", "tu", "tú", "él", "ella", "nosotros", "vosotros", "ellos", "ellas", "este", "esta", "esto", "ese", "esa", "eso", "aquel",
    "aquella", "aquello", "su", "sus", "mi", "mis", "tus", "es", "son", "fue", "fueron", "ser", "está", "están", "estar", "ha", "han", "haber", "hay", "tiene",
    "tienen", "tener", "sea", "sean", "será", "fui", "fuiste", "no", "sí", "también", "más", "menos", "muy", "mucho", "mucha", "muchos", "muchas", "poco",
    "todo", "todos", "toda", "todas", "ya", "aún", "solo", "sólo", "cada", "otro", "otra", "otros", "otras", "mismo", "misma",
)


def medical_vocabulary(
    phrases: DataFrame, column: str, min_length: int = 4, stop_words: tuple[str, ...] = STOP_WORDS
) -> DataFrame:
    """Distinct letter runs of the phrases, long enough and not among ``stop_words``."""
    cells = phrases.where(F.col(column).isNotNull()).select(column).distinct()
    runs = F.explode(F.split(nfkc_casefold(column), f"[^{LETTERS}]+"))
    return (
        cells.select(runs.alias("word"))
        .where((F.length("word") >= min_length) & ~F.col("word").isin(*stop_words))
        .distinct()
    )


def vocabulary_form(words: DataFrame, column: str) -> DataFrame:
    """Add ``form``: the word in evaluation form without non-letters at its edges."""
    return words.withColumn(
        "form", F.regexp_replace(nfkc_casefold(column), f"^[^{LETTERS}]+|[^{LETTERS}]+$", "")
    )


def categorise(words: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Add ``category``: medical when the edge-trimmed word is in the vocabulary, else generic.

    Give it distinct words with counts rather than running text.
    """
    known = vocabulary.select(F.col("word").alias("form"), F.lit("medical").alias("_c"))
    return (
        vocabulary_form(words, column)
        .join(known, "form", "left")
        .withColumn("category", F.coalesce("_c", F.lit("generic")))
        .drop("_c", "form")
    )


def fill_windows(sizes: Column, capacity: int) -> Column:
    """Start offsets of the windows over a document's sub-token stream.

    Words fill a window in order and are never cut; a word larger than a whole
    window is cut wherever a window is full. ``sizes`` holds sub-tokens per word.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("starts")
    )

    def step(s: Column, size: Column) -> Column:
        long_word = size > capacity
        filled = s["used"] + size
        cuts = F.when(long_word, F.floor(filled / capacity)).otherwise(
            F.when(filled > capacity, 1).otherwise(0)
        ).cast("int")
        first = F.when(long_word, s["at"] + capacity - s["used"]).otherwise(s["at"])
        more = F.when(
            cuts > 0,
            F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda k: (first + k * capacity).cast("int")),
        ).otherwise(F.expr("cast(array() as array<int>)"))
        used = F.when(long_word, filled - cuts * capacity).otherwise(
            F.when(filled > capacity, size).otherwise(filled)
        )
        return F.struct(
            (s["at"] + size).cast("int").alias("at"),
            used.cast("int").alias("used"),
            F.when(cuts > 0, F.concat(s["starts"], more)).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(
        F.transform(sizes, lambda x: x.cast("int")),
        start,
        step,
        lambda s: F.filter(s["starts"], lambda w: w < s["at"]),
    )


def _reached(offsets: pa.Array, starts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each offset its row, how many starts of the row are at or before it, and all starts with each row's first."""
    place, edges = edges_of(offsets), edges_of(starts)
    row, owner = np.repeat(np.arange(len(offsets)), np.diff(place)), np.repeat(np.arange(len(starts)), np.diff(edges))
    at, start = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (offsets, starts))
    return row, np.searchsorted((owner << 32) + start, (row << 32) + at, "right") - edges[row], start, edges


@F.arrow_udf(ArrayType(IntegerType()))
def window_of(offsets: pa.Array, starts: pa.Array) -> pa.Array:
    """Number of the last start at or before each offset."""
    return in_rows(pa.array(_reached(offsets, starts)[1] - 1, pa.int32()), offsets)


@F.arrow_udf(ArrayType(IntegerType()))
def start_after(offsets: pa.Array, starts: pa.Array) -> pa.Array:
    """The first start behind each offset; -1 where there is none."""
    row, reached, start, edges = _reached(offsets, starts)
    at = edges[row] + reached
    return in_rows(pa.array(np.where(at < edges[row + 1], np.append(start, -1)[at], -1), pa.int32()), offsets)


def window_words(docs: DataFrame, key: str, words: str, sizes: str, capacity: int, *keep: str) -> DataFrame:
    """One row per (document, window, word): sub-tokens of the word inside the window; kept columns last.

    Starts, offsets and the window of each word are arrays of the document's own row, exploded once: nothing is
    shuffled, and no row carries the list of starts.
    """
    whole = F.transform(sizes, lambda x: x.cast("int"))
    filled = docs.where(F.size(words) > 0).select(
        key, *keep, F.col(words).alias("_words"), whole.alias("_sizes"), fill_windows(F.col(sizes), capacity).alias("_starts"))
    filled = filled.withColumn("_at", running_offsets(F.col("_sizes")))
    cells = F.arrays_zip(
        F.col("_words").alias("word"), F.col("_sizes").alias("size"), F.col("_at").alias("at"),
        window_of("_at", "_starts").alias("first"), start_after("_at", "_starts").alias("next"))
    placed = filled.select(key, *keep, F.posexplode(cells).alias("word_idx", "c")).select(key, *keep, "word_idx", "c.*")
    stop = F.col("at") + F.col("size")
    inner = F.when(
        (F.col("next") >= 0) & (F.col("next") < stop), F.sequence(F.col("next"), stop - 1, F.lit(capacity))
    ).otherwise(F.expr("cast(array() as array<int>)"))
    placed = placed.withColumn("_edges", F.concat(F.array("at"), inner, F.array(stop)))
    parts = F.posexplode(F.slice("_edges", F.lit(1), F.size("_edges") - 1)).alias("_k", "_from")
    return placed.select(key, *keep, "word_idx", "word", "first", "_edges", parts).select(
        key,
        (F.col("first") + F.col("_k")).cast("int").alias("window_idx"),
        "word_idx",
        "word",
        (F.get("_edges", F.col("_k") + 1) - F.col("_from")).cast("int").alias("size"),
        *keep,
    )


#: Shares of the drawn words that are masked, and masked or made random.
_MASKED, _CHANGED = round(0.8 * 2**32), round(0.9 * 2**32)


def mask_words(placed: DataFrame, key: str, share: float = 0.18, seed: int = 42, alone: str | None = None) -> DataFrame:
    """Words to mask per window, and how: mask, random or keep (80/10/10 per word).

    Words are drawn in digest order until the share of the window's sub-tokens,
    half-even rounded and at least one, is reached.

    ``alone`` names a boolean column: true on rows whose window comes whole and in word order in one task, as ``window_words``
    makes those of a key that stands in one row. These are drawn as they pass; only the others are shuffled and ordered.
    """
    if alone is None:
        return _drawn_by_window(placed, key, share, seed)
    columns = [key, "window_idx", "word_idx", "word", "size"]
    kind = StructType([*(placed.schema[c] for c in columns), StructField("treatment", StringType(), False)])
    passing = placed.where(F.col(alone)).select(*columns, F.col(key).cast("string").alias("_text"))
    drawn = passing.mapInArrow(_drawn_in_place(share, seed), kind)
    return drawn.unionByName(_drawn_by_window(placed.where(~F.col(alone)), key, share, seed))


def _drawn_in_place(share: float, seed: int):
    """Rows of one window after the other to the drawn ones; the last window of a batch waits for the next batch."""
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([] if held is None else held.to_batches()), batch]).combine_chunks()
            opens = first_rows(table)
            last = int(opens[-1])
            held = table.slice(last)
            if last:
                yield from drawn(table.slice(0, last), opens[:-1])
        if held is not None:
            yield from drawn(held.combine_chunks(), np.zeros(1, np.int64))

    def first_rows(table):
        keys = pc.dictionary_encode(table["_text"].combine_chunks(), null_encoding="encode")
        key = keys.indices.to_numpy(zero_copy_only=False)
        window, word = (table[c].to_numpy() for c in ("window_idx", "word_idx"))
        # a word stands in a window once, in rising order
        return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (window[1:] != window[:-1]) | (word[1:] <= word[:-1])]))

    def drawn(table, opens):
        n = np.diff(np.append(opens, table.num_rows))
        size, word = (table[c].to_numpy().astype(np.int64) for c in ("size", "word_idx"))
        names = zip(table["_text"].take(pa.array(opens)).to_pylist(), table["window_idx"].to_numpy()[opens].tolist(), strict=True)
        # the digests of seeded_hash; a null key has no part in the text
        heads = ["|".join([str(seed), *([] if k is None else [k]), str(w), ""]).encode() for k, w in names]
        raw = b"".join([md5(heads[i] + b"%d" % w, usedforsecurity=False).digest() for i, w in zip(np.repeat(np.arange(len(n)), n).tolist(), word.tolist(), strict=True)])
        high, low = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2).T
        row = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((word, low, high, row))
        upto = np.cumsum(size[by])
        before = upto - size[by]
        before -= np.repeat(before[opens], n)
        target = np.maximum(1, np.rint(np.add.reduceat(size, opens) * share))
        kept = np.sort(by[before < np.repeat(target, n)])
        dice = high[kept] & np.uint64(0xFFFFFFFF)
        treatment = pa.array(["mask", "random", "keep"]).take(pa.array((dice >= _MASKED).astype(np.int8) + (dice >= _CHANGED)))
        yield from table.drop_columns("_text").take(pa.array(kept)).append_column("treatment", treatment).combine_chunks().to_batches()

    return run


def _drawn_by_window(placed: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    window = [key, "window_idx"]
    digest = seeded_hash(seed, F.col(key), F.col("window_idx"), F.col("word_idx"))
    drawn = placed.withColumn("_digest", digest)
    before = Window.partitionBy(*window).orderBy("_digest", "word_idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*window)
    target = F.greatest(F.lit(1), F.bround(F.sum("size").over(whole) * F.lit(share)))
    ready = drawn.withColumn("_target", target).withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # The leading 32 bits ordered the draw; the next 32 decide the treatment.
    dice = F.substring("_digest", 9, 8)
    treatment = (
        F.when(dice < F.lit(f"{_MASKED:08x}"), F.lit("mask"))
        .when(dice < F.lit(f"{_CHANGED:08x}"), F.lit("random"))
        .otherwise(F.lit("keep"))
    )
    return ready.where(F.col("_before") < F.col("_target")).select(
        *window, "word_idx", "word", "size", treatment.alias("treatment")
    )
