"""Tokens by word rules: a worked table, and texts beside a plain reading of the rules."""

import random

import pytest

from glossmark.operators import matching, word_rules
from glossmark.operators.tokens import bio_tokens

WORKED = {
    "aprox.": ["aprox."], "(aprox.)": ["(", "aprox.", ")"], "Aprox.,": ["Aprox.", ","], "EE.UU.": ["EE.UU."], "p.ej.:": ["p.ej.", ":"],
    "10mg": ["10", "mg"], "(2,5mg).": ["(", "2,5", "mg", ")", "."], "37°C": ["37", "°C"], "5%": ["5%"], "%5": ["%", "5"], "3.": ["3", "."],
    "1.500,25": ["1.500,25"], "B.": ["B."], "pal": ["pa", "l"], "Pal": ["Pa", "l"], "papal": ["papal"], "fin.Otra": ["fin", ".", "Otra"],
    "a,b,c": ["a", ",", "b", ",", "c"], "y/o": ["y", "/", "o"], "2+3": ["2", "+", "3"], "+34": ["+34"], "+": ["+"], "fin...": ["fin", "..."],
    "sí......": ["sí", "......"], "¿Qué?": ["¿", "Qué", "?"], "«no»": ["«", "no", "»"], "franco-suizo": ["franco-suizo"], "a--b": ["a", "--", "b"],
    "Juan's": ["Juan", "'s"], "10mg/ml": ["10mg", "/", "ml"], "20€": ["20", "€"], "mg": ["mg"], "...": ["..."], "Dr": ["Dr"], "Dr.!": ["Dr.", "!"],
    "x" * 5000: ["x" * 5000], "fin" + "." * 40: ["fin", "." * 40],
}


def test_worked_table():
    cutter = word_rules.Cutter(word_rules.SPANISH)
    assert {w: cutter.parts(w) for w in WORKED} == WORKED
    many = "!" * 200_000
    assert cutter.parts(many) == list(many)
    with pytest.raises(ValueError, match="don't make it up"):
        word_rules.WordRules({"ab": ("a", "c")})


def test_tokens_keep_offsets_and_sentences(spark):
    rng = random.Random(4)
    texts = [rng.choice(["", "  ", "\n"]) + "".join(rng.choice(list(WORKED)) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += ["", " \n", "El Dr. Paz vio aprox. 3 casos. Nada más, etc. y fin."]
    rows = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string")
    found = {}
    for t in word_rules.rule_tokens(rows, "id").orderBy("id", "idx").collect():
        found.setdefault(t.id, []).append(t)
        assert texts[t.id][t.start:t.end] == t.token
    for i, text in enumerate(texts):
        assert [t.token for t in found.get(i, [])] == [p for w in text.split() for p in WORKED.get(w, word_rules.Cutter(word_rules.SPANISH).parts(w))]
    last = found[len(texts) - 1]
    assert [t.token for t in last if t.sent_idx == 1] == ["Nada", "más", ",", "etc.", "y", "fin", "."]
    assert max(t.sent_idx for t in last) == 1
    by_pattern = bio_tokens(rows.where(f"id = {len(texts) - 1}"), "id").toPandas()
    assert by_pattern.sent_idx.max() > 1


def test_labels_over_rule_tokens(spark):
    docs = spark.createDataFrame([(1, "c", "Dolor (10mg) y fiebre.Tos")], "doc_id int, code string, text string")
    mentions = spark.createDataFrame([("c", "REACT", "fiebre"), ("c", "REACT", "tos"), ("c", "ACTIVE", "dolor")], "code string, type string, mention string")
    found = matching.search(docs, mentions, "doc_id", "code", ["REACT", "ACTIVE"], resolve=True)
    rows = matching.label_documents(found, "doc_id", cut=word_rules.word_pieces).orderBy("idx").collect()
    assert [(r.token, r.label) for r in rows] == [
        ("Dolor", "B-ACTIVE"), ("(", "O"), ("10", "O"), ("mg", "O"), (")", "O"), ("y", "O"), ("fiebre", "B-REACT"), (".", "O"), ("Tos", "B-REACT")]
