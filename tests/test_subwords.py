"""Sub-words of a vocabulary table beside a plain longest-match loop."""

import random

import pytest
from pyspark.sql import functions as F

from glossmark.operators import subwords


def plain(word, pieces):
    ids, at = [], 0
    while at < len(word):
        fits = [n for n in range(1, len(word) - at + 1) if ("##" if at else "") + word[at:at + n] in pieces]
        if not fits or len(word) > subwords.MOST_LETTERS:
            return [0]
        ids.append(pieces[("##" if at else "") + word[at:at + max(fits)]])
        at += max(fits)
    return ids


def test_pieces_labels_and_totals(spark):
    rng = random.Random(8)
    parts = sorted({"".join(rng.choice("abñ") for _ in range(rng.randint(1, 3))) for _ in range(15)})
    pieces = {p: i for i, p in enumerate([*parts, *("##" + p for p in parts if p != "b")], 1)}
    vocabulary = spark.createDataFrame([*pieces.items(), (parts[0], 10**6), (None, 5)], "piece string, piece_id int")
    words = [["".join(rng.choice("abñz" if rng.random() < 0.1 else "abñ") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    words += [["a" * 100, "a" * 101, None, ""], [], ["a"] * 500]
    rows = spark.createDataFrame([*enumerate(words), (999, None)], "id int, words array<string>")
    encoded = subwords.encode_sentences(rows, vocabulary).withColumn("labels", F.transform("words", lambda _, i: i + 1))
    got = {r.id: r for r in encoded.withColumn("a", subwords.first_piece_labels(F.col("pieces"), F.col("labels"))).collect()}
    for i, row in enumerate(words):
        want = [plain(w or "", pieces) for w in row]
        assert got[i].pieces == want
        assert got[i].a == [x for k, p in enumerate(want, 1) for x in [k, *[-100] * (len(p) - 1)][:len(p)]]
    assert got[999].pieces is None
    sizes = [sum(len(plain(w or "", pieces)) for w in row) for row in words]
    unknown = sum(plain(w or "", pieces) == [0] for row in words for w in row)
    total = subwords.token_totals(encoded, 16).first()
    assert tuple(total) == (len(words), sum(map(len, words)), unknown, sum(sizes), sum(min(n + 2, 16) for n in sizes), sum(n + 2 > 16 for n in sizes))


def test_empty_tables(spark):
    vocabulary = spark.createDataFrame([], "piece string, piece_id int")
    rows = spark.createDataFrame([(["a", ""],)], "words array<string>")
    assert subwords.encode_sentences(rows, vocabulary).first().pieces == [[0], []]
    assert tuple(subwords.token_totals(subwords.encode_sentences(rows.limit(0), vocabulary)).first()) == (0,) * 6


def test_vocabulary_bound(spark, monkeypatch):
    monkeypatch.setattr(subwords, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        subwords.piece_ids(spark.createDataFrame([(c, i) for i, c in enumerate("abc")], "piece string, piece_id int"))
