"""What is made of one document's words is made in its row: no word is shuffled, and rows that share a key still meet."""

import os
import random
import tempfile
from collections import defaultdict
from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossmark.operators import masking, ordering, word_rules
from glossmark.plans import inputs, response_queries, tagging_queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents whose keys stand alone, and one in which some repeat or are null."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdeñ", k=rng.randint(1, 9))) for _ in range(n))
    rows = [(i, f"{text(300)}. {text(200)}\n{text(100)}", "es", f"src{i % 3}", i) for i in range(200)]
    odd = [(1, "uno dos. Tres", "es", "s", 1), (1, "cinco 5,5% y", "es", "s", 2), (2, "solo", "es", "s", 3), (None, "nada", "es", "s", 4), (None, "otra", "es", "s", 5),
           (1, "uno dos. Tres", "es", "s", 1), (3, None, "es", "s", 6), (4, text(400), "es", "s", 7), (4, text(300), "es", "s", 8)]
    folders = {}
    for name, made in (("alone", rows), ("shared", odd)):
        folders[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{folders[name]}/documents.parquet")
        spark.createDataFrame([(1, "abcd eeee"), (2, text(20))], "item_id long, text string").write.parquet(f"{folders[name]}/benchmark.parquet")
    return folders


def shuffled(spark, df):
    """Bytes of the shuffle files that running ``df`` adds."""
    folder = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
    files = lambda: {f: f.stat().st_size for f in folder.glob("blockmgr-*/*/shuffle_*.data")}
    before = files()
    df.write.format("noop").mode("overwrite").save()
    return sum(size for f, size in files().items() if f not in before)


def size_of_texts(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]


def test_rows_whose_key_stands_alone(spark):
    rows = [(1, "a"), (2, "b"), (None, "c"), (2, "d"), (None, "e")]
    found = ordering.mark_alone(spark.createDataFrame(rows, "k int, v string"), "k")
    assert sorted(tuple(r) for r in found.select("v", "_alone").collect()) == [("a", True), ("b", False), ("c", False), ("d", False), ("e", False)]
    assert [r._alone for r in ordering.mark_alone(spark.createDataFrame(rows[1:3], "k int, v string"), "k").collect()] == [True, True]


def test_many_repeated_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_TOLD_KEYS", 0)
    test_rows_whose_key_stands_alone(spark)


def test_tokens_as_lists(spark, tables):
    docs = spark.read.parquet(f"{tables['shared']}/documents.parquet").where("n_chars > 2")
    rows = defaultdict(list)
    for r in word_rules.rule_tokens(docs, "n_chars", "text", "doc_id").orderBy("n_chars", "idx").collect():
        rows[r.n_chars, r.doc_id].append((r.idx, r.token, r.start, r.end, r.sent_idx))
    lists = word_rules.rule_tokens(docs, "n_chars", "text", "doc_id", lists="t").collect()
    assert {(r.n_chars, r.doc_id): [(t.idx, t.token, t.start, t.end, t.sent_idx) for t in r.t] for r in lists} == rows and len(rows) == 5


def test_rule_token_counts_shuffle_no_tokens(spark, tables):
    assert shuffled(spark, tagging_queries.QUERIES["rule_token_counts"](spark, tables["alone"])) < size_of_texts(spark, tables["alone"]) / 4


@pytest.mark.parametrize("name", ["alone", "shared"])
def test_rule_token_counts_by_key(spark, tables, name):
    docs = spark.read.parquet(f"{tables[name]}/documents.parquet")
    note = [F.col(x) if x in docs.columns else F.lit(x) for x in tagging_queries._NOTE]
    want = defaultdict(list)
    for r in word_rules.rule_tokens(docs.select("doc_id", F.concat("text", *note).alias("text")), "doc_id").collect():
        want[r.doc_id].append((r.start, r.token, r.sent_idx, r.end))
    got = {r.doc_id: tuple(r)[1:] for r in tagging_queries.QUERIES["rule_token_counts"](spark, tables[name]).collect()}
    assert got == {
        k: (len(t), len({x[1] for x in t}), len({x[2] for x in t}), max(x[3] for x in t), md5(" ".join(x[1] for x in sorted(t)).encode()).hexdigest())
        for k, t in want.items()}


@pytest.mark.parametrize("name", ["mask_words", "mask_summary"])
def test_masks_shuffle_no_words(spark, tables, monkeypatch, name):
    monkeypatch.setattr(inputs, "spread", lambda rows, *keys: rows)
    assert shuffled(spark, response_queries.QUERIES[name](spark, tables["alone"])) < size_of_texts(spark, tables["alone"]) / 2


@pytest.mark.parametrize("name", ["alone", "shared"])
@pytest.mark.parametrize("rows", [7, 10_000])
def test_masks_in_place_are_those_by_window(spark, tables, monkeypatch, name, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(map(repr, response_queries._masked(spark, tables[name]).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = masking.mask_words(response_queries._placed(spark, tables[name]), "doc_id").collect()
    assert len(got) > 100 and got == sorted(map(repr, want))


def test_masks_of_odd_keys(spark):
    """A null key, keys whose texts hold the separator, words of several windows and windows of a word."""
    cases = [(None, [1, 2, 3] * 9), ("a|1", [50, 1, 1, 90]), ("a", [3] * 40), ("", [1])]
    docs = spark.createDataFrame([(k, [f"w{i}" for i in range(len(s))], s) for k, s in cases], "k string, words array<string>, sizes array<int>").coalesce(1)
    for seed in (42, 7):
        want = masking.mask_words(masking.window_words(docs, "k", "words", "sizes", 20), "k", 0.25, seed)
        placed = masking.window_words(ordering.mark_alone(docs, "k"), "k", "words", "sizes", 20, "_alone")
        got = masking.mask_words(placed, "k", 0.25, seed, alone="_alone")
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
