"""Tokens with character offsets, and sentences.

Text is cut after marks that a regex puts behind each token. Offsets, sentence
numbers and labels come from one Arrow function over whole columns of a document's
own pieces, some hundred thousand at a time. So a document's tokens come out of its
row, no text is shuffled, and a task holds no more than a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Private-use character that ends a token.
MARK = "\ue000"

#: Word-level token of the BIO sequences: number, word with inner dots or dashes, dash run, sign.
BIO_TOKEN = (
    r"\p{Nd}+(?:[.,]\p{Nd}+)*%?"
    r"|[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*"
    r"|--+"
    r"|[^\p{L}\p{N}_\s]"
)
#: Signs that close a sentence.
CLOSERS = (".", "!", "?", "…")


def without_marks(text: Column) -> Column:
    return F.translate(text, MARK, "\ufffd")


#: Elements of array columns that are handled at once, and the white space before a token.
AT_ONCE = 1 << 18
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def edges_of(lists: pa.ListArray) -> np.ndarray:
    """Where each row's elements begin among all of them, and the end; a null row has none."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])


def in_rows(values: pa.Array, like: pa.ListArray) -> pa.ListArray:
    """``values`` in rows of the same sizes as ``like``; null rows stay null."""
    return pa.ListArray.from_arrays(pa.array(edges_of(like), pa.int32()), values, mask=like.is_null())


def row_slices(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of rows whose sizes make up ``most``; at least a row."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield slice(at, end)
        at = end


@F.arrow_udf(ArrayType(IntegerType()))
def running_offsets(lengths: pa.Array) -> pa.Array:
    """Sum of the lengths before each place."""
    edges = edges_of(lengths)
    return in_rows(pa.array(_sums_before(lengths.flatten().to_numpy(zero_copy_only=False), edges), pa.int32()), lengths)


def _sums_before(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of a row's values before each of them."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[:-1] - np.repeat(sums[edges[:-1]], np.diff(edges))


def _sentences(breaks: np.ndarray, sign: np.ndarray, closes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sentence of each token: one more at a line break, and at the first word after a closing sign."""
    at, first = np.arange(len(sign)), np.repeat(edges[:-1], np.diff(edges))

    def last_before(flag):
        last = np.maximum.accumulate(np.concatenate([[-1], np.where(flag, at, -1)]))[:-1]
        return np.where(last < first, -1, last)

    opens = (at > first) & (breaks | (~sign & (last_before(closes) > last_before(~sign))))
    return _sums_before(opens, edges) + opens


def _labels(starts: np.ndarray, sentences: np.ndarray, edges: np.ndarray, spans: pa.ListArray) -> pa.Array:
    """BIO label of each token start: what the last span at or before it says, then I to B where nothing precedes.

    ``spans`` are sorted and don't overlap, so one search per token decides.
    """
    found, span_edges = spans.flatten(), edges_of(spans)
    if not len(found):
        return pa.repeat(pa.scalar("O"), len(starts))
    first, end = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    kinds = found.field("type").dictionary_encode()
    row, span_row = np.repeat(np.arange(len(edges) - 1), np.diff(edges)), np.repeat(np.arange(len(span_edges) - 1), np.diff(span_edges))
    last = np.searchsorted((span_row << 32) + first, (row << 32) + starts, "right") - 1
    inside = (last >= span_edges[row]) & (end[last] > starts)
    of = np.where(inside, kinds.indices.to_numpy()[last], -1)
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = (row[1:] == row[:-1]) & (sentences[1:] == sentences[:-1]) & (of[1:] == of[:-1]) & (first[last[1:]] != starts[1:])
    names = ["O", *(head + kind for kind in kinds.dictionary.to_pylist() for head in ("B-", "I-"))]
    return pa.array(names, pa.string()).take(pa.array(np.where(of < 0, 0, 1 + 2 * of + goes_on)))


def pattern_pieces(text: Column) -> Column:
    """The text cut behind each ``BIO_TOKEN``; a piece holds the white space before its token."""
    marked = F.regexp_replace(without_marks(text), f"(?U)({BIO_TOKEN})", "$1" + MARK)
    return F.filter(F.split(marked, MARK), lambda p: p != "")


def bio_tokens(
    docs: DataFrame, key: str, text: str = "text", *keep: str, spans: str | None = None, cut: Callable[[Column], Column] = pattern_pieces,
    lists: str | None = None,
) -> DataFrame:
    """One row per word-level token: key, kept columns, idx, token, start, end, sent_idx.

    A sentence starts after a line break, and at the first token that is not
    punctuation after a closing sign. ``spans`` names a column of sorted spans; tokens then get a label too.
    ``cut`` makes the array of pieces that join to the text. With ``lists`` a text that has tokens is one row, with all of
    them as an array of that name: what is counted per text then needs no shuffle.
    """
    held = () if spans is None else (F.col(spans).alias("_spans"),)
    pieces = docs.select(F.struct(key, *keep).alias("_head"), cut(F.col(text)).alias("_pieces"), *held)
    numbers = [StructField(c, IntegerType()) for c in ("idx", "start", "end", "sent_idx")]
    label = [] if spans is None else [StructField("label", StringType())]
    cells = [*numbers, StructField("token", StringType()), *label]
    names = [f.name for f in cells]
    order = [c for c in ("idx", "token", "start", "end", "sent_idx", "label") if c in names]
    if lists is not None:
        cells, order = [StructField(lists, ArrayType(StructType(cells)))], [lists]
    kind = StructType([StructField("_head", pieces.schema["_head"].dataType), *cells])
    return pieces.mapInArrow(_tokens(names, lists), kind).select(F.col("_head")[key].alias(key), *[F.col("_head")[c].alias(c) for c in keep], *order)


def _tokens(names: list[str], listed: str | None = None):
    """Rows of pieces to one row per token, or to one per row that has tokens, with the column ``listed``."""
    def run(batches):
        for batch in batches:
            for rows in row_slices(np.diff(edges_of(batch.column("_pieces")))):
                yield tokens(batch.slice(rows.start, rows.stop - rows.start))

    def tokens(batch):
        lists = batch.column("_pieces")
        edges, piece = edges_of(lists), lists.flatten()
        token = pc.utf8_ltrim(piece, _SPACE)
        size, bare = (pc.utf8_length(x).to_numpy().astype(np.int64) for x in (piece, token))
        end = _sums_before(size, edges) + size
        # most pieces share their token with others, so patterns are tried on distinct ones
        forms = token.dictionary_encode()
        sign, closes = (f(forms.dictionary).to_numpy(zero_copy_only=False)[forms.indices.to_numpy()] for f in (_is_sign, _closes)) if len(piece) else (np.zeros(0, bool),) * 2
        led = np.flatnonzero(size > bare)
        breaks = np.zeros(len(size), bool)
        breaks[led] = pc.match_substring(piece.take(pa.array(led)), "\n").to_numpy(zero_copy_only=False)
        sentence = _sentences(breaks, sign, closes, edges)
        kept = np.flatnonzero(bare > 0)
        row = np.repeat(np.arange(len(lists)), np.diff(edges))
        columns = {"idx": np.arange(len(size)) - edges[row], "start": end - bare, "end": end, "sent_idx": sentence}
        out = {c: pa.array(v[kept], pa.int32()) for c, v in columns.items()} | {"token": token.take(pa.array(kept))}
        if "label" in names:
            out["label"] = _labels(end - bare, sentence, edges, batch.column("_spans")).take(pa.array(kept))
        if listed is None:
            return pa.RecordBatch.from_arrays([batch.column("_head").take(pa.array(row[kept])), *[out[c] for c in names]], names=["_head", *names])
        rows, n = np.unique(row[kept], return_counts=True)
        cells = pa.StructArray.from_arrays([out[c] for c in names], names=names)
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), cells)
        return pa.RecordBatch.from_arrays([batch.column("_head").take(pa.array(rows)), own], names=["_head", listed])

    return run


def _is_sign(tokens: pa.Array) -> pa.Array:
    return pc.match_substring_regex(tokens, r"^\p{P}+$")


def _closes(tokens: pa.Array) -> pa.Array:
    return pc.is_in(tokens, pa.array(CLOSERS))
