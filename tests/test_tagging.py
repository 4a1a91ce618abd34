"""Dictionary matching, overlap resolution and BIO projection against brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossmark.operators import matching
from glossmark.operators.tokens import bio_tokens
from glossmark.sources import conll

TYPES = ["REACT", "ACTIVE", "FREQ", "SYS"]


def plain(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()


def occurrences(value, mention):
    edge = r"[\wÀ-ſ]"
    return [(m.start(), m.end()) for m in re.finditer(f"(?<!{edge}){re.escape(plain(mention))}(?!{edge})", plain(value))]


def greedy(value, mentions):
    taken = []
    order = sorted(mentions, key=lambda m: (TYPES.index(m[0]), -len(m[1]), m[1]))
    for kind, mention in order:
        for s, e in occurrences(value, mention):
            if all(e <= a or b <= s for a, b, _ in taken):
                taken.append((s, e, kind))
    return sorted(taken)


def run(spark, docs, mentions):
    d = spark.createDataFrame([(i, "c", t) for i, t in enumerate(docs)], "doc_id int, code string, text string")
    m = spark.createDataFrame([("c", k, x) for k, x in mentions], "code string, type string, mention string")
    found = matching.find_spans(d, m, "doc_id", "code", TYPES)
    return d, found, matching.resolve_overlaps(found, "doc_id")


def chosen(resolved, doc=0):
    return sorted((r.start, r.end, r.type) for r in resolved.where(F.col("doc_id") == doc).collect())


@pytest.mark.parametrize("value,mentions,expected", [
    ("costos tos tosco", [("REACT", "tos")], [(7, 10, "REACT")]),
    ("βb b", [("REACT", "b")], [(3, 4, "REACT")]),
    ("ßb b", [("REACT", "b")], [(3, 4, "REACT")]),
    ("dolor agudo", [("REACT", "dolor"), ("SYS", "dolor agudo")], [(0, 5, "REACT")]),
    ("dolor agudo", [("REACT", "dolor"), ("REACT", "dolor agudo")], [(0, 11, "REACT")]),
    ("a (ecg) b(ecg)", [("REACT", "(ecg)")], [(2, 7, "REACT")]),
    ("a a a", [("REACT", "a a")], [(0, 3, "REACT")]),
    ("😀 b", [("REACT", "b")], [(2, 3, "REACT")]),
])
def test_worked_cases(spark, value, mentions, expected):
    _, _, resolved = run(spark, [value], mentions)
    assert chosen(resolved) == expected


def test_random_texts_match_brute_force(spark):
    rng = random.Random(11)
    pieces = ["ab", "Áb", "b", "a", "-", "(", ")", ".", " ", " ", " ", "\n", "ñ", "β", "1", "_"]
    docs = ["".join(rng.choice(pieces) for _ in range(40)) for _ in range(120)]
    mentions = list({
        (rng.choice(TYPES), m)
        for m in ("".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))).strip() for _ in range(60))
        if m
    })
    _, _, resolved = run(spark, docs, mentions)
    got = {}
    for r in resolved.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type))
    for i, value in enumerate(docs):
        assert sorted(got.get(i, [])) == greedy(value, mentions), value


def test_long_mentions(spark):
    long = " ".join(f"palabra{i}" for i in range(200))
    docs = [f"x {long} y", long[:-3], f"({long})", f"{long}, {long}"]
    _, found, _ = run(spark, docs, [("REACT", long), ("SYS", "palabra7 palabra8")])
    got = sorted((r.doc_id, r.start, r.end) for r in found.where("type = 'REACT'").collect())
    n = len(long)
    assert got == [(0, 2, n + 2), (2, 1, n + 1), (3, 0, n), (3, n + 2, 2 * n + 2)]
    assert found.where("type = 'SYS'").count() == 5


def test_frequency_pairs(spark):
    rows = spark.createDataFrame(
        [("1", "FRECUENTE", "dolor"), ("1", None, " "), ("2", "RARA", "Frecuente"), (None, "FRECUENTE", "x")],
        "codigo string, frecuencia string, reacadv string",
    )
    got = {tuple(r) for r in matching.collect_mentions(rows, "codigo", ["FREQ", "REACT"]).collect()}
    assert got == {
        ("1", "FREQ", "FRECUENTE"), ("1", "FREQ", "frecuente"), ("1", "FREQ", "frecuentes"),
        ("1", "REACT", "dolor"), ("2", "FREQ", "RARA"), ("2", "REACT", "Frecuente"),
    }


def test_projection_and_sentences(spark):
    d, _, resolved = run(
        spark, ["Dolor agudo. Tos-seca fuerte\nfin.\n- otra"], [("REACT", "dolor agudo"), ("SYS", "seca fuerte")]
    )
    labelled = matching.project_labels(bio_tokens(d.select("doc_id", "text"), "doc_id"), resolved, "doc_id")
    rows = matching.sentence_rows(labelled, "doc_id").orderBy("sent_idx").collect()
    assert [(r.tokens, r.labels) for r in rows] == [
        (["Dolor", "agudo", "."], ["B-REACT", "I-REACT", "O"]),
        (["Tos-seca", "fuerte"], ["O", "B-SYS"]),
        (["fin", "."], ["O", "O"]),
        (["-"], ["O"]),
        (["otra"], ["O"]),
    ]


def test_conll_round_trip(spark, tmp_path):
    rows = [("#12", 0, ["#", "a\tb"], ["O", "B-A"]), ("#12", 1, ["c"], ["O"]), ("7", 0, ["d"], ["B-A"])]
    df = spark.createDataFrame(rows, "codigo string, sent_idx int, tokens array<string>, labels array<string>")
    target = str(tmp_path / "out")
    conll.write_conll(df, "codigo", target)
    back = conll.read_conll(spark, target).orderBy("codigo", "sent_idx").collect()
    assert [(r.codigo, r.sent_idx, r.tokens, r.labels) for r in back] == [
        ("#12", 0, ["#", "a b"], ["O", "B-A"]), ("#12", 1, ["c"], ["O"]), ("7", 0, ["d"], ["B-A"]),
    ]


def test_configs_in_the_row_choose_as_the_span_table_does(spark):
    rng = random.Random(11)
    words = ["a", "b", "c", "a b", "b c", "a b c"]
    listed = spark.createDataFrame([("s", t, w) for t in TYPES for w in words if rng.random() < 0.7], "source string, type string, mention string")
    docs = spark.createDataFrame([(i, "s", " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None, "a b")],
                                 "doc_id long, source string, text string")
    configs = {"one": ["ACTIVE"], "two": ["SYS", "REACT"], "all": TYPES}
    found = matching.search(docs, listed, "doc_id", "source", TYPES).select("doc_id", F.explode(matching.resolve_configs(F.col("spans"), configs)).alias("s"))
    got = sorted((r.s.config, r.doc_id, *r.s[1:]) for r in found.collect())
    table = matching.find_spans(docs, listed, "doc_id", "source", TYPES)
    want = [(name, *r) for name, types in configs.items() for r in matching.resolve_overlaps(table.where(F.col("type").isin(types)), "doc_id").collect()]
    assert got == sorted(want) and len(got) > 500
