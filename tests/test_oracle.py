"""Every query with SQL gives the same rows as DuckDB on the whole tables."""

import pytest
from __spark_entry__ import oracle_sql, queries
from comparing import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_text_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = queries()[name](spark, sf_dir).toArrow()
    want = duck.sql(oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) is None
    types = {f.name: str(f.type) for f in got.schema}
    assert types == {f.name: str(f.type) for f in want.schema}
