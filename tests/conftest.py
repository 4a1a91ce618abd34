import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glossmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over a one-row frame with the given columns."""
    def evaluate(expression, **columns):
        from pyspark.sql import functions as F

        df = spark.range(1)
        for name, value in columns.items():
            if isinstance(value, list):
                df = df.withColumn(name, F.array(*[F.lit(v) for v in value]))
            else:
                df = df.withColumn(name, F.lit(value))
        return df.select(expression.alias("v")).first()[0]

    return evaluate
