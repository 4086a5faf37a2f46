import os

import pytest

import __spark_entry__
from cellweave.plans.registry import QUERIES, SQL
from tests.oracle import FOLDER, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, connection, name):
    same(spark, connection, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["stack", "section", "wx", "wy", "pos", "value"] and df.count() > 0
    assert set(SQL) <= set(QUERIES)
