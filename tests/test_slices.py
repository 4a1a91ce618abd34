"""Arrow functions hold a few rows of a batch at a time, and give the same whichever way a batch is cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmark.functions.text import nfkc_casefold
from glossmark.operators import masking, matching, subwords, tokens, word_rules


def test_slices_of_rows():
    assert [(s.start, s.stop) for s in tokens.row_slices(np.array([3, 3, 9, 0, 0, 2]), 6)] == [(0, 2), (2, 3), (3, 6)]
    assert list(tokens.row_slices(np.array([], int))) == []


def test_a_batch_of_many_pieces_gives_small_batches_of_tokens():
    pieces = pa.array([["a", " b", "."] * 20_000, None, [], ["\nc"]] * 12, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pieces], names=["_head", "_pieces"])
    names = ["idx", "start", "end", "sent_idx", "token"]
    parts = list(tokens._tokens(names)([batch]))
    assert len(parts) > 2 and max(p.num_rows for p in parts) <= tokens.AT_ONCE
    rows = pa.Table.from_batches(parts)
    last = rows.slice(60_000, 1).to_pylist()
    assert rows.num_rows == 12 * 60_001 and last == [{"_head": 3, "idx": 0, "start": 1, "end": 2, "sent_idx": 0, "token": "c"}]


@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_functions_give_the_same_by_any_slices(spark, monkeypatch, most):
    cut = lambda sizes: cut.plain(sizes, most)
    cut.plain = tokens.row_slices
    for module in (tokens, word_rules, subwords):
        monkeypatch.setattr(module, "row_slices", cut)
    rows = [(1, "Uno dos. Tres\n ¿cua-tro? 5,5%"), (2, None), (3, ""), (4, "pal Dr. x ﬁn"), (5, " \n ")]
    docs = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = [(r.id, r.idx, r.token, r.start, r.end, r.sent_idx) for r in tokens.bio_tokens(docs, "id").orderBy("id", "idx").collect()]
    assert got == [
        (1, 0, "Uno", 0, 3, 0), (1, 1, "dos", 4, 7, 0), (1, 2, ".", 7, 8, 0), (1, 3, "Tres", 9, 13, 1), (1, 4, "¿", 15, 16, 2),
        (1, 5, "cua-tro", 16, 23, 2), (1, 6, "?", 23, 24, 2), (1, 7, "5,5%", 25, 29, 3),
        (4, 0, "pal", 0, 3, 0), (4, 1, "Dr", 4, 6, 0), (4, 2, ".", 6, 7, 0), (4, 3, "x", 8, 9, 1), (4, 4, "ﬁn", 10, 12, 1)]
    ruled = [r.token for r in word_rules.rule_tokens(docs, "id").orderBy("id", "idx").collect()]
    assert ruled == ["Uno", "dos", ".", "Tres", "¿", "cua-tro", "?", "5,5%", "pa", "l", "Dr.", "x", "ﬁn"]
    assert [r[0] for r in docs.orderBy("id").select(nfkc_casefold("text")).collect()][1:4] == ["", "", "pal dr. x fin"]
    offsets = spark.createDataFrame([(1, [0, 3, 7], [0, 3]), (2, [], [0]), (3, [0, 5], [0, 2, 4, 6])], "id int, o array<int>, s array<int>").coalesce(1)
    placed = offsets.select("id", masking.window_of("o", "s").alias("w"), masking.start_after("o", "s").alias("n")).orderBy("id").collect()
    assert [(r.w, r.n) for r in placed] == [([0, 1, 1], [3, -1, -1]), ([], []), ([0, 2], [2, 6])]
    spans = spark.createDataFrame([(1, "ñandú x", [("A", "m", 0, 5), ("A", "m", 6, 7)]), (2, "", None), (3, "é", [("B", "m", 0, 1)])],
                                  "id int, text string, spans array<struct<type:string,mention:string,start:int,end:int>>")
    assert sorted(r.surface for r in matching.span_surfaces(spans, "id").collect()) == ["x", "é", "ñandú"]
