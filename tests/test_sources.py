"""Readers, writers and the landing stream on temporary folders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glossmark.sources import sinks, tables
from glossmark.streaming.landing import landed_documents, process_landed


def test_annotations_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        " CODIGO ,MEDICAMENTO,PACTIVO,REACADV,FRECUENCIA,SISTEMA\n"
        '0077 ,M,P,"uno\ndos",nan,S\n0078,NA,P,None,NULL,\n', encoding="utf-8",
    )
    got = [tuple(r) for r in tables.read_annotations(spark, str(path)).select("codigo", "medicamento", "reacadv", "frecuencia", "sistema").collect()]
    assert got == [("0077", "M", "uno\ndos", None, "S"), ("0078", None, None, None, None)]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match=r"\['PACTIVO', 'X'\]"):
        tables.require_columns(spark.range(1), ["id", "X", "PACTIVO"])
    with pytest.raises(KeyError):
        tables.resolve_column(["a"], ["b"])
    assert tables.code_column(["x", "Codigo"]) == "Codigo" and tables.code_column(["x", "y"]) == "x"


def test_texts_and_lines(spark, tmp_path):
    for name, body in (("01", "a\nb"), ("02", "c")):
        (tmp_path / f"{name}.txt").write_text(body, encoding="utf-8")
    texts = tables.read_texts(spark, str(tmp_path))
    assert sorted(map(tuple, texts.collect())) == [("01", "a\nb"), ("02", "c")]
    codes = spark.createDataFrame([("01",), ("09",)], "codigo string")
    have, missing = tables.attach_texts(codes, texts)
    assert [r.codigo for r in have.collect()] == ["01"] and [r.codigo for r in missing.collect()] == ["09"]
    lines = tables.read_lines(spark, str(tmp_path), codes)
    assert [tuple(r) for r in lines.collect()] == [("02", "c")]


def test_entity_files(spark, tmp_path):
    good = {"codigo": "01", "variante": 1, "codigo_variant": "01_v1", "extra": 1,
            "entities": [{"type": "REACT", "canonical": "c", "surface": "s", "start": 0, "end": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    rows, bad = tables.read_entity_files(spark, str(tmp_path))
    assert [r.codigo for r in rows.collect()] == ["01"]
    assert [r.file_name for r in bad.collect()] == ["b.json"]


def test_predictions_tree(spark, tmp_path):
    folder = tmp_path / "model x" / "few-shot"
    folder.mkdir(parents=True)
    record = {"principio activo": "p", "reacción adversa": "r", "frecuencia": "f", "trastorno": "t"}
    (folder / "0012.json").write_text(json.dumps([record, record], ensure_ascii=False), encoding="utf-8")
    got = tables.read_predictions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("model x", "few-shot", "0012", i, "p", "r", "f", "t") for i in (0, 1)]


def test_registry(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "s").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps({"nregistro": "1", "nombre": "n", "estado": {"aut": 5}}))
    sections = [{"seccion": "4.7", "contenido": "x"}, {"seccion": "4.8", "contenido": "<p>uno</p>"}, {"seccion": "4.8", "contenido": "dos"}]
    (tmp_path / "s" / "1.json").write_text(json.dumps(sections))
    (tmp_path / "s" / "2.json").write_text("{}")
    drugs = tables.read_registry(spark, str(tmp_path / "d"), str(tmp_path / "s"))
    got = tables.with_section(drugs, "4.8").collect()
    assert [(r.nregistro, r.contenido, r.estado.aut) for r in got] == [("1", "<p>uno</p>", 5)]


def test_pages_and_codes(one, spark):
    assert one(tables.page_requests(F.lit(15), 7)) == [1, 2, 3]
    assert one(tables.page_requests(F.lit(0), 7)) == []
    a = spark.createDataFrame([(" 01",), (None,), ("",)], "codigo string")
    b = spark.createDataFrame([("01",), ("02",)], "codigo string")
    assert sorted(map(tuple, tables.distinct_codes([a, b]).collect())) == [("01", 0), ("02", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "k string, v double")
    assert sorted(r.value for r in sinks.report_json(df).collect()) == ['{"k":"a","v":null}', '{"k":"b","v":1.0}']
    target = str(tmp_path / "p")
    sinks.append_new(df.unionByName(df), "k", target)
    sinks.append_new(df, "k", target)
    assert spark.read.parquet(target).count() == 2
    assert sinks.config_name(["REACT", "SYS"]) == "react-sys"
    examples = df.withColumn("config", F.lit("react")).withColumn("split", F.lit("train"))
    sinks.write_examples(examples, str(tmp_path / "e"))
    assert (tmp_path / "e" / "config=react" / "split=train").is_dir()


def test_nested_reports_and_manifest(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, nan], (nan, [nan]), {"m": nan})], "a array<double>, s struct<x:double,y:array<float>>, m map<string,double>")
    text = sinks.report_json(df).first().value
    assert json.loads(text) == {"a": [1.0, None], "s": {"x": None, "y": [None]}, "m": {"m": None}}
    sinks.write_report(df, str(tmp_path / "r"))
    for name in ("b.json", "a b.json"):
        (tmp_path / name).write_text("{}")
    index = sinks.report_index(spark, str(tmp_path)).where("file_name LIKE '%.json'")
    assert sinks.report_manifest(index).first() == (2, ["a b.json", "b.json"])


def test_documents_and_csv(spark, tmp_path):
    docs = spark.createDataFrame([("1_v1", "t", [("REACT", "s")], "1"), ("2_v1", "u", [], "2")], "codigo_variant string, text string, entities array<struct<type:string,surface:string>>, codigo string")
    sinks.write_documents(docs, str(tmp_path / "d"))
    assert (tmp_path / "d" / "txt" / "codigo=1").is_dir()
    assert spark.read.json(str(tmp_path / "d" / "entities")).count() == 2
    rows = spark.createDataFrame([("01", 'a "b"', "x\ny", None)], "CODIGO string, MEDICAMENTO string, PACTIVO string, ORIG string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert [tuple(r) for r in back.collect()] == [("01", 'a "b"', "x\ny", None)]


def test_synthetic_annotations_csv(spark, tmp_path):
    names = "CODIGO,MEDICAMENTO,PACTIVO,REACADV,FRECUENCIA,SISTEMA,PACTIVO_CANONICAL,REACADV_CANONICAL,FRECUENCIA_CANONICAL,SISTEMA_CANONICAL,ORIG_CODIGO,VARIANTE"
    (tmp_path / "s.csv").write_text(names + "\n 01_v2 ,m,p,r,nan,s,P,R,,S, 01 ,2\n", encoding="utf-8")
    row = tables.read_synth_annotations(spark, str(tmp_path / "s.csv")).first()
    assert (row.codigo, row.orig_codigo, row.variante, row.frecuencia, row.reacadv_canonical) == ("01_v2", "01", 2, None, "R")


def test_conll_headers_and_tokens(spark, tmp_path):
    from glossmark.sources import conll

    (tmp_path / "a.conll").write_text("# 01\n# x\tO\ny\tB-A\n\n# z\tO\n\n# 02\nw\tO\n")
    (tmp_path / "b.conll").write_text("tok\tO\n")
    got = sorted(((r.codigo or "", r.sent_idx, r.tokens) for r in conll.read_conll(spark, str(tmp_path)).collect()))
    assert got == [("", 0, ["tok"]), ("01", 0, ["# x", "y"]), ("01", 1, ["# z"]), ("02", 0, ["w"])]


def test_conll_ranges_equal_whole_file(spark, tmp_path):
    """Whatever the size of the ranges, each document is read once and whole."""
    from glossmark.sources import conll

    rng = random.Random(3)
    body = "".join(
        f"# {i}\n" + "".join(rng.choice(["a\tO\n", "# b\tB-X\n", "#\tO\n", "é\tO\r\n", "\n"]) for _ in range(rng.randint(0, 9))) + "\n"
        for i in range(60))
    for name, start in (("a.conll", ""), ("b.conll", "t\tO\n\n"), ("_c.conll", "no\tO\n")):
        (tmp_path / name).write_bytes((start + body).encode())
    (tmp_path / "empty.conll").write_text("")

    def rows(size):
        return sorted((r.codigo or "", r.sent_idx, r.tokens, r.labels) for r in conll.read_conll(spark, str(tmp_path), size).collect())

    whole = rows(1 << 20)
    assert len({c for c, *_ in whole}) > 40 and ("", 0, ["t"], ["O"]) in whole and not any("no" in t for _, _, t, _ in whole)
    texts = spark.read.text([str(tmp_path / "a.conll"), str(tmp_path / "b.conll")], wholetext=True).withColumn("path", F.lit("p"))
    plain = conll.parse_blocks(texts, "path", "value").collect()
    assert whole == sorted((r.codigo or "", r.sent_idx, r.tokens, r.labels) for r in plain)
    for size in (41, 1001):
        assert rows(size) == whole


def test_conll_lines_end_at_line_feeds_only(spark):
    """Tokens with other separators than U+000A stay tokens, as the SQL counts them, and open no document."""
    from glossmark.sources import conll

    tokens = ["a\u2028#\tb", "#\tx\u2028y", "#\rz\u0085", "w\tv", "\u2029"]
    rows = spark.createDataFrame([(7, 0, tokens, ["O", "B-A", "I-A", "O", "O"]), (7, 2, ["end"], ["B-B"])], "code long, sent_idx int, tokens array<string>, labels array<string>")
    back = conll.parse_blocks(conll.document_blocks(rows, "code"), "code", "block").orderBy("sent_idx").collect()
    assert [(r.codigo, r.sent_idx, r.tokens, r.labels) for r in back] == [
        ("7", 0, ["a\u2028# b", "# x\u2028y", "# z\u0085", "w v", "\u2029"], ["O", "B-A", "I-A", "O", "O"]), ("7", 1, ["end"], ["B-B"])]


def test_conll_cuts_each_text_once(spark, capsys):
    from glossmark.plans import inputs
    from glossmark.sources import conll

    texts = spark.createDataFrame([("p", "# 1\r\na\tO\tmore\r\nb\tB-A\nno tab\n \r\nc\t")], "path string, value string").repartition(1)
    parsed = conll.parse_blocks(texts, "path", "value")
    assert [(r.codigo, r.sent_idx, r.tokens, r.labels) for r in parsed.collect()] == [("1", 0, ["a", "b"], ["O", "B-A"]), ("1", 1, ["c"], [""])]
    capsys.readouterr()
    parsed.select("codigo", F.size("tokens"), "labels").explain()
    assert capsys.readouterr().out.count("split(") == 3  # documents, sentences, lines
    inputs.hashed_sentences(spark, "/root/testdata/sf0.001").select("doc_id", "gold").explain()
    assert capsys.readouterr().out.count("split(") == 2  # lines, words


def test_conll_range_owns_each_document_once():
    from glossmark.sources.conll import owned_documents

    data = b"x\tO\n# 1\na\tO\n# b\tO\n\n# 2\n# 3\nc\tO"
    for size in range(1, len(data) + 2):
        got = []
        for start in range(0, len(data), size):
            at = start if not start else start + len(data[start - 1:].split(b"\n", 1)[0])
            got += owned_documents(data[at:].splitlines(keepends=True), at, min(start + size, len(data)), start == 0)
        assert got == [b"x\tO\n", b"# 1\na\tO\n# b\tO\n\n", b"# 2\n", b"# 3\nc\tO"]


def test_committed_outputs(spark, tmp_path):
    root = str(tmp_path / "run")
    kind = "codigo_variant string, text string, entities array<struct<type:string,surface:string>>, codigo string"
    sinks.commit_documents(spark.createDataFrame([("1_v1", "t", [("REACT", "s")], "1"), ("2_v1", None, [], "2")], kind), root)
    assert {r.name: r.rows for r in sinks.committed(spark, root).collect()} == {"raw": 2, "txt": 2, "entities": 2}
    assert sinks.read_committed(spark, root, "entities").where("codigo = '1'").first().entities[0].surface == "s"
    broken = spark.createDataFrame([("3_v1", "u", [], "3")], kind)
    with pytest.raises(Exception, match="stop"):
        sinks.write_committed(spark, {"raw": ("parquet", broken), "txt": ("parquet", broken.select(F.raise_error(F.lit("stop")).alias("x")))}, root)
    assert sorted(r.codigo for r in sinks.read_committed(spark, root, "raw").collect()) == ["1", "2"]
    sinks.commit_documents(broken.limit(0), root)
    assert [sinks.read_committed(spark, root, n).count() for n in ("raw", "txt", "entities")] == [0, 0, 0]
    with pytest.raises(KeyError):
        sinks.read_committed(spark, root, "other")


def test_committed_prompts(spark, tmp_path):
    prompts = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "r")], "codigo string, prompt string")
    sinks.commit_prompts(prompts, str(tmp_path / "p"))
    assert {r.codigo: r.prompts for r in sinks.read_committed(spark, str(tmp_path / "p"), "counts").collect()} == {"1": 2, "2": 1}
    assert sinks.read_committed(spark, str(tmp_path / "p"), "prompts").count() == 3


def test_landing_resumes(spark, tmp_path):
    landing, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps({"codigo": c, "text": t}) for c, t in rows))
        stream = landed_documents(spark, str(landing))
        process_landed(stream, lambda batch: batch.withColumn("n", F.length("text")), target, state).awaitTermination()
        return sorted((r.codigo, r.n) for r in spark.read.parquet(target).collect())

    assert land("1.json", [("a", "xx"), ("a", "xxx")])[0][0] == "a"
    assert [c for c, _ in land("2.json", [("a", "y"), ("b", "yy")])] == ["a", "b"]
