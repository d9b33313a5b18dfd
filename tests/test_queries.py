"""Every query of the core registry against its SQL on the smallest tables."""

import pytest

from askwright.plans import registry

from .conftest import DATA, canonical

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = canonical(df.columns, df.collect())
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert got == canonical(want.columns, want.fetchall())
    else:
        assert got[1]


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
