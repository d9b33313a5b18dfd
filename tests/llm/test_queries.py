"""Queries of the subpackage against their SQL, and the names the driver asks for."""

import pytest

from askwright.llm import registry

from ..conftest import DATA, canonical

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE[name])
    assert canonical(df.columns, df.collect()) == canonical(want.columns, want.fetchall())


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
