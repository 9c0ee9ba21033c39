"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import differences, duck, type_differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert type_differences(df, ORACLES[name], con) == {}
        assert differences(df, ORACLES[name], con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
