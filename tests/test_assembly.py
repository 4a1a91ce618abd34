import pytest
from pyspark.sql import functions as F

from glossmark.operators import assembly


def test_gold_falls_back_to_the_split(spark):
    full = spark.createDataFrame([("1", "a"), ("1", "b"), ("3", "c"), (None, "n")], "codigo string, reacadv string")
    split = spark.createDataFrame([("1", "own"), ("2", "only here")], "codigo string, reacadv string")
    got = sorted(map(tuple, assembly.gold_rows(full, split, "codigo").collect()))
    assert got == [("1", "a", "full"), ("1", "b", "full"), ("2", "only here", "split")]
    assert assembly.gold_rows(full.limit(0), split, "codigo").where("origin = 'split'").count() == 2


def test_selection_keeps_order_and_names_unknown_codes(spark):
    wanted = spark.createDataFrame([("b", 1), ("x", 2), ("a", 3), ("c", 4)], "k string, pos int")
    known = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    chosen, unknown = assembly.select_codes(wanted, known, "k", "pos", limit=2)
    assert [r.k for r in chosen.orderBy("pos").collect()] == ["b", "a"] and [r.k for r in unknown.collect()] == ["x"]


def test_configs_keep_their_types_and_ids(spark):
    rows = spark.createDataFrame([(1, ["B-REACT", "I-REACT", "O", "B-SYS"])], "doc int, labels array<string>")
    got = {r.config: (r.labels, r.ner_tags) for r in assembly.config_examples(rows, "labels", [["REACT"], ["SYS", "REACT"]]).collect()}
    assert got == {
        "react": (["B-REACT", "I-REACT", "O", "O"], [1, 2, 0, 0]),
        "sys-react": (["B-REACT", "I-REACT", "O", "B-SYS"], [3, 4, 0, 1]),
    }


def test_templates_later_types_win(spark):
    df = spark.createDataFrame([("a b c a b".split(), "a b", "b c", None)], "words array<string>, x string, y string, z string")
    labels = assembly.templated_labels(F.col("words"), [("X", F.col("x")), ("Y", F.col("y")), ("Z", F.col("z"))])
    assert df.select(labels.alias("l")).first().l == ["B-X", "B-Y", "I-Y", "B-X", "I-X"]


@pytest.mark.parametrize("bad", [(0, 1, 0.3, 1.0), (1, 0, 0.3, 1.0), (1, 1, 1.2, 1.0), (1, 1, 0.3, -1.0)])
def test_generation_parameters(bad):
    assembly.check_generation(1, 3, 0.3, 0.7)
    with pytest.raises(ValueError):
        assembly.check_generation(*bad)


def test_config_counts_and_ids_without_repeated_sentences(spark):
    rows = [
        (1, 0, "train", ["B-REACT", "I-REACT", "O"]), (1, 1, "train", ["B-SYS", "O"]), (1, 10, "train", ["B-FREQ"]),
        (2, 0, "test", ["O", None, "B-ACTIVE", "I-FREQ"]), (3, 2, "test", []),
    ]
    sentences = spark.createDataFrame(rows, "doc_id long, sent_idx int, split string, labels array<string>")
    configs = [["REACT"], ["ACTIVE", "FREQ"], ["REACT", "ACTIVE", "FREQ", "SYS"]]
    examples = assembly.config_examples(sentences, "labels", configs)
    counts = assembly.label_counts(sentences, "labels", ["split"])
    plain = assembly.label_counts(examples, "labels", ["config", "split"])
    assert sorted(assembly.config_label_counts(counts, configs, ["split"]).select("config", "split", "label", "n").collect()) == sorted(plain.collect())
    got = {(r.doc_id, r.config): r.ids for r in assembly.config_id_texts(sentences, "labels", "doc_id", "sent_idx", configs).collect()}
    want = {}
    for r in sorted(examples.collect(), key=lambda r: (r.doc_id, r.sent_idx)):
        want.setdefault((r.doc_id, r.config), []).append(",".join(map(str, r.ner_tags)))
    assert got == {k: ";".join(v) for k, v in want.items()}


def test_templated_labels_of_overlaps_and_missing_values(spark):
    rows = [(["a", "a", "a", "b"], "a a", None), (["x", "y"], "", "y z"), (None, "a", "b"), (["p", "q", "p"], " p  q ", "q p")]
    cells = spark.createDataFrame(rows, "words array<string>, x string, y string")
    got = cells.select(assembly.templated_labels(F.col("words"), [("X", F.col("x")), ("Y", F.col("y"))]).alias("l")).collect()
    assert [r.l for r in got] == [["B-X", "B-X", "I-X", "O"], ["O", "O"], None, ["B-X", "B-Y", "I-Y"]]
