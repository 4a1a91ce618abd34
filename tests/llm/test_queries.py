"""The registered queries beside their SQL, and the pipeline's stages."""

import os
from pathlib import Path

import pytest

from check import compare, duck
from glossmark.llm import queries as llm

SF_DIR = os.environ.get("GLOSSMARK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_equals_sql(spark, name):
    state, *_, detail = compare(spark, duck(SF_DIR), SF_DIR, name, llm.QUERIES[name], llm.ORACLES[name])
    assert state == "ok", detail


def test_held_out_quality(spark):
    scored = llm.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01").where("held_out")
    known = scored.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (known.predicted == known.quality).mean() > 0.95


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(step)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(step)))
        if step < 4:
            assert docs.columns == first.columns
        if step < 2:
            assert 0 < docs.count() < before.count() and docs.exceptAll(before).count() == 0
        if step in (2, 4):
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
