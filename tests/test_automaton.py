"""The automaton, the offset map and the interval set beside plain versions."""

import random
import re
import time

import pytest

from glossmark.operators import matching
from glossmark.operators.automaton import Chooser, Finder, chosen, folded


@pytest.mark.parametrize(("text", "form", "at"), [
    ("abc", "abc", "abc"), ("ÉBOLA", "ebola", "ÉBOLA"), ("x ébola y", "ebola", "ébola"), ("café.", "cafe", "café"),
    ("Ιός", "ιος", "Ιός"), ("Жёлтый", "желтыи", "Жёлтый"), ("İx", "ix", "İx"), ("à́ b", "a", "à́"), ("😀 ño", "no", "ño"),
])
def test_offsets_through_the_fold(text, form, at):
    assert form in folded(text)[0]
    spans = Finder([("T", 0, form)]).spans(text)
    assert [text[s:e] for *_, s, e in spans] == [at] == [text[s:e] for *_, s, e in Finder([("T", 0, at)]).spans(text)]


def test_search_finds_decomposed_letters(spark):
    docs = spark.createDataFrame([(1, "c", "El ébola y el ébola"), (2, None, "ébola"), (3, "d", "ébola"), (4, "c", None)], "doc_id int, code string, text string")
    mentions = spark.createDataFrame([("c", "REACT", "ébola"), ("e", "REACT", "x"), (None, "REACT", "ébola")], "code string, type string, mention string")
    rows = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in matching.search(docs, mentions, "doc_id", "code", ["REACT"], resolve=True).collect()}
    assert rows == {1: [(3, 9), (15, 20)], 2: [], 3: [], 4: []}


def test_hot_code_in_parts(spark, monkeypatch):
    monkeypatch.setattr(matching, "PART_DOCUMENTS", 7)
    docs = spark.createDataFrame([(i, "hot" if i % 3 else "cold", f"dolor {i} tos") for i in range(90)], "doc_id int, code string, text string")
    mentions = spark.createDataFrame([("hot", "REACT", "tos"), ("cold", "REACT", "dolor")], "code string, type string, mention string")
    got = sorted((r.doc_id, r.mention) for r in matching.find_spans(docs, mentions, "doc_id", "code", ["REACT"]).collect())
    assert got == [(i, "tos" if i % 3 else "dolor") for i in range(90)]


def plain_choice(spans):
    taken, read = [], {}
    for kind, rank, mention, s, e in sorted(spans, key=lambda x: (x[1], -len(x[2]), x[2], x[3], x[4], x[0])):
        if s >= read.get((rank, mention), 0):
            read[rank, mention] = e
            if all(e <= a or b <= s for *_, a, b in taken):
                taken.append((kind, rank, mention, s, e))
    return sorted(taken, key=lambda x: x[3])


def test_choice_beside_the_plain_loop():
    pick = random.Random(3)
    for _ in range(300):
        spans = []
        for _ in range(pick.randrange(25)):
            mention, start = "m" * pick.randrange(1, 6), pick.randrange(40)
            spans.append((pick.choice("XY"), pick.randrange(2), mention, start, start + len(mention)))
        spans = list({s[1:]: s for s in spans}.values())
        assert chosen(spans) == plain_choice(spans)


def test_long_chain_of_candidates(spark):
    started, chooser = time.perf_counter(), Chooser()
    kept = sum(chooser.takes(0, f"{i:06d}", 2 * i, 2 * i + 3) for i in range(100_000))
    assert kept == 50_000 and time.perf_counter() - started < 20
    rows = spark.range(100_000).selectExpr("1 AS doc_id", "'T' AS type", "0 AS type_rank", "lpad(id, 6, '0') AS mention", "int(2 * id) AS start", "int(2 * id + 3) AS end")
    assert matching.resolve_overlaps(rows, "doc_id").count() == 50_000


def test_labels_merged_in_the_row(spark):
    pick = random.Random(9)
    words = ["dolor", "agudo", "tos", "-", ".", "fin", "\n", "Tos-seca"]
    docs = spark.createDataFrame([(i, "c", " ".join(pick.choice(words) for _ in range(30))) for i in range(40)] + [(99, "c", ""), (98, None, "tos")], "doc_id int, code string, text string")
    mentions = spark.createDataFrame([("c", "REACT", "dolor agudo"), ("c", "SYS", "tos"), ("c", "REACT", "tos dolor"), ("c", "SYS", "seca")], "code string, type string, mention string")
    types = ["REACT", "SYS"]
    merged = matching.label_documents(matching.search(docs, mentions, "doc_id", "code", types, resolve=True), "doc_id")
    spans = matching.resolve_overlaps(matching.find_spans(docs, mentions, "doc_id", "code", types), "doc_id")
    joined = matching.project_labels(matching.bio_tokens(docs, "doc_id"), spans, "doc_id")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, joined.select(*merged.columns).collect()))
    assert re.search("Window", merged._jdf.queryExecution().toString()) is None


def test_leftmost_occurrences_of_a_row(spark):
    docs = spark.createDataFrame([(1, "s", "dolor leve, Dolor y dolor leve"), (2, "s", None)], "doc_id long, source string, text string")
    words = spark.createDataFrame([("s", "REACT", "dolor"), ("s", "SYS", "dolor"), ("s", "REACT", "dolor leve")], "source string, type string, mention string")
    first = matching.find_spans(docs, words, "doc_id", "source", ["REACT", "SYS"], first=True)
    assert sorted((r.doc_id, r.mention, r.start, r.end) for r in first.collect()) == [(1, "dolor", 0, 5), (1, "dolor leve", 0, 10)]
    every = matching.find_spans(docs, words, "doc_id", "source", ["REACT", "SYS"])
    assert every.count() == 8
