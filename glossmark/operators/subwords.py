"""Sub-words of a given vocabulary: longest pieces first, first-piece labels, token totals.

The vocabulary is a table (piece, piece_id); pieces that continue a word begin with '##'. It is the only thing that
goes to every task, and its size is checked first. Words are encoded inside their own row, each distinct word of
some hundred thousand once, so neither words nor texts are shuffled and a frequent word is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from glossmark.functions.labels import align_subwords
from glossmark.operators.tokens import edges_of, in_rows, row_slices

#: Most pieces of a vocabulary, and letters beyond which a word is unknown.
MOST_PIECES, MOST_LETTERS = 1 << 18, 100
CONTINUES = "##"
UNKNOWN_ID = 0


def longest_pieces(word: str, pieces: dict[str, int], longest: int) -> list[int]:
    """Ids of the longest pieces from left to right; a word that they don't cover, or a very long one, is unknown."""
    if len(word) > MOST_LETTERS:
        return [UNKNOWN_ID]
    ids, at = [], 0
    while at < len(word):
        head = CONTINUES if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            if (found := pieces.get(head + word[at:end])) is not None:
                break
        else:
            return [UNKNOWN_ID]
        ids.append(found)
        at = end
    return ids


def piece_ids(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """Expression from an array of words to an array of id arrays, by ``vocabulary`` (piece, piece_id).

    A null array stays null, a null or empty word has no pieces. Of a piece with several ids the smallest counts. A vocabulary
    of more than ``MOST_PIECES`` rows is refused.
    """
    rows = vocabulary.where("piece IS NOT NULL").groupBy("piece").agg(F.min("piece_id").alias("id")).limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    pieces = {r.piece: r.id for r in rows}
    longest = max((len(p.removeprefix(CONTINUES)) for p in pieces), default=0)
    shared = vocabulary.sparkSession.sparkContext.broadcast((pieces, longest))

    @F.arrow_udf(ArrayType(ArrayType(IntegerType())))
    def encode(words: pa.Array) -> pa.Array:
        table, most = shared.value
        out = []
        for rows in row_slices(np.diff(edges_of(words))):
            here = words[rows]
            forms = pc.fill_null(here.flatten(), "").dictionary_encode()
            ids = pa.array([longest_pieces(w, table, most) for w in forms.dictionary.to_pylist()], pa.list_(pa.int32()))
            out.append(in_rows(ids.take(forms.indices), here))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.list_(pa.int32())))

    return encode


def encode_sentences(sentences: DataFrame, vocabulary: DataFrame, words: str = "words") -> DataFrame:
    """``sentences`` with ``pieces``: the id array of each word."""
    return sentences.withColumn("pieces", piece_ids(vocabulary)(F.col(words)))


def first_piece_labels(pieces: Column, label_ids: Column) -> Column:
    """Label of each piece: a word's first piece has the word's, the others are ignored; words without pieces have none."""
    sized = F.filter(F.arrays_zip(F.transform(pieces, F.size).alias("n"), label_ids.alias("id")), lambda c: c["n"] > 0)
    return align_subwords(F.transform(sized, lambda c: c["n"]), F.transform(sized, lambda c: c["id"]))


def token_totals(encoded: DataFrame, limit: int = 128, special: int = 2) -> DataFrame:
    """One row: sentences, words, unknown words, pieces, and the tokens a model sees.

    Each sentence adds ``special`` tokens and is cut to ``limit``; ``cut`` counts the sentences that are.
    """
    n = F.aggregate("pieces", F.lit(0), lambda s, p: s + F.size(p))
    unknown = F.size(F.filter("pieces", lambda p: p == F.array(F.lit(UNKNOWN_ID))))
    rows = encoded.where("pieces IS NOT NULL").select(n.alias("n"), F.size("pieces").alias("words"), unknown.alias("unknown"))

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)

    return rows.agg(
        F.count("*").alias("sentences"), total(F.col("words"), "words"), total(F.col("unknown"), "unknown"), total(F.col("n"), "pieces"),
        total(F.least(F.col("n") + special, F.lit(limit)), "tokens"), total((F.col("n") + special > limit).cast("int"), "cut"))
