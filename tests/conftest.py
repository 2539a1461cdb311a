import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wayfold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema, partitions=None):
        df = spark.createDataFrame(rows, schema)
        return df.repartition(partitions) if partitions else df
    return make


@pytest.fixture
def one(spark):
    """Value of one Column expression over literal input columns."""
    def value(expr, **columns):
        types = {str: "string", int: "bigint", float: "double", bool: "boolean", list: "array<string>"}
        schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in columns.items()) or "x int"
        row = tuple(columns.values()) or (1,)
        return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]
    return value
