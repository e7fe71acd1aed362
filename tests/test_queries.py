"""Every registered query against its SQL twin; queries without SQL must run."""
import pytest

import __spark_entry__ as entry
from tests.oracle import ROOT, compare, duck

SF = f"{ROOT}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        out = QUERIES[name](spark, SF)
        assert out.columns and out.limit(1).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
