import pytest

from tests.llm.edge_cases import edge_texts


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows with a null key and source, a repeated row, and columns whose names operators use inside."""
    rows = [(i + 1, t, "en", ("b", "a", None, "c")[i % 4], len(t or "")) for i, t in enumerate(edge_texts())]
    rows += [(None, "null key text here", "en", "a", 1), rows[4], rows[7]]
    rows = [(*r, "x", "y", "z", 7, 8) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row string, key string, mix string, n long, _key long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
