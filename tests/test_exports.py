"""Order of first sight, ranks, export shapes, CoNLL pairs, label mappings, parsed cells, span surfaces."""

import json

import pytest
from pyspark.sql import functions as F

from glossmark.operators import assembly, matching, quality
from glossmark.sources import conll, sinks, tables


def test_codes_in_order_of_first_sight(spark):
    a = spark.createDataFrame([("b ", 5), (" ", 0), ("a", 9), ("b", 2), (None, 1)], "codigo string, at int")
    b = spark.createDataFrame([("c", 1), ("a", 0)], "codigo string, at int")
    got = tables.distinct_codes([a, b], position="at").orderBy("first_frame", "first_position").collect()
    assert [tuple(r) for r in got] == [("b", 0, 2), ("a", 0, 9), ("c", 1, 1)]
    assert tables.distinct_codes([a, b]).columns == ["codigo", "first_frame"]


def test_ranks_break_ties_by_value(spark):
    rows = spark.createDataFrame([("g", "z", 3), ("g", "a", 3), ("g", "m", 7), ("h", "q", 1)], "k string, label string, n long")
    got = {(r.k, r.label): r["rank"] for r in quality.ranked_counts(rows, "label", groups=["k"]).collect()}
    assert got == {("g", "m"): 1, ("g", "a"): 2, ("g", "z"): 3, ("h", "q"): 1}
    assert [r.label for r in quality.ranked_counts(rows, "label").orderBy("rank").collect()] == ["m", "a", "z", "q"]


def test_payload_has_empty_texts_for_missing_cells(spark):
    rows = spark.createDataFrame([("1", "á", None), ("1", "á", "y")], "codigo string, a string, b string")
    got = assembly.hallucination_payload(rows, "codigo", {"a": "principio_activo", "b": "trastorno"}).collect()
    assert sorted(json.loads(r.entry)["trastorno"] for r in got) == ["", "y"]
    assert {json.loads(r.entry)["principio_activo"] for r in got} == {"á"}


def test_conll_pair_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([
        ("train", "A", 1, ["x\ty", "#z"], ["O", "B-REACT"]), ("train", "A", 0, ["uno"], ["O"]), ("test", "A", 0, ["dos"], ["B-SYS"]),
        ("test", "B", 0, ["tres", "cuatro"], ["O", "O"]),
    ], "split string, codigo string, sent_idx int, tokens array<string>, labels array<string>")
    conll.write_split_conll(rows, "codigo", str(tmp_path / "pair"))
    for side, want in (("train", [("A", 0, ["uno"]), ("A", 1, ["x y", "#z"])]), ("test", [("A", 0, ["dos"]), ("B", 0, ["tres", "cuatro"])])):
        got = conll.read_conll(spark, str(tmp_path / "pair" / f"split={side}")).orderBy("codigo", "sent_idx").collect()
        assert [(r.codigo, r.sent_idx, r.tokens) for r in got] == want
    with pytest.raises(ValueError, match="split them first"):
        conll.split_blocks(rows.drop("split"), "codigo")


def test_label_mapping_is_written_whole(spark, tmp_path):
    mapping = assembly.label_mapping(["REACT", "SYS", "REACT"])
    sinks.write_json(spark, mapping, str(tmp_path / "labels"))
    read = json.loads(spark.read.text(str(tmp_path / "labels"), wholetext=True).first()[0])
    assert read == mapping
    assert read["entity_types"] == ["REACT", "SYS"]
    assert all(read["label_to_id"][label] == int(i) for i, label in read["id_to_label"].items()) and len(read["id_to_label"]) == 5


def test_parsed_cells(spark):
    raw = spark.createDataFrame([(" 007 ", "m", "r", "p", "NaN", "")], ["CODIGO ", "MEDICAMENTO", "reaccion_adversa", "PACTIVO", "FRECUENCIA", "SISTEMA"])
    assert tuple(tables.parse_annotations(raw).select("codigo", "reacadv", "frecuencia", "sistema").first()) == ("007", "r", None, None)
    with pytest.raises(ValueError, match="missing required columns"):
        tables.parse_annotations(raw.drop("SISTEMA"))


def test_surfaces_are_raw_slices(spark):
    docs = spark.createDataFrame([(1, "c", "Hay ébola y ÉBOLA."), (2, "c", None), (3, "c", "")], "doc_id int, code string, text string")
    mentions = spark.createDataFrame([("c", "REACT", "ebola")], "code string, type string, mention string")
    found = matching.search(docs, mentions, "doc_id", "code", ["REACT"], resolve=True)
    got = matching.span_surfaces(found, "doc_id").orderBy("start").collect()
    assert [r.surface for r in got] == ["ébola", "ÉBOLA"]
    assert tuple(matching.offset_integrity(found.where(F.col("doc_id") == 1), "doc_id").first())[:2] == ("REACT", 2)
