"""Registered queries beside their SQL. GLOSSMARK_ALL=1 compares all of them."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from check import compare, duck

SF_DIR = os.environ.get("GLOSSMARK_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "fold_text", "code_normalise", "variant_keys", "section_cut", "span_resolve", "bio_tag", "bio_spans",
    "tag_scores", "span_schema_scores", "tuple_recovery", "entity_split", "row_split", "json_array", "consolidate",
)
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


def names():
    return list(contract.queries()) if os.environ.get("GLOSSMARK_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    state, *_, detail = compare(spark, con, SF_DIR, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert state in ("ok", "rows-only"), detail


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["label", "n", "pct"] and df.count() > 0
