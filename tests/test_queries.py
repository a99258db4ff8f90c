"""Every registered graph query against its SQL oracle, on the smallest tables."""

import pytest

from graphloom import queries as Q
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, con, sql) is None


def test_only_iterative_queries_lack_an_oracle():
    assert set(Q.queries()) - set(Q.oracle_sql()) == {"betweenness", "label_propagation", "louvain"}
