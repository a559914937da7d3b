import os

import pytest

from lexloom.plans import tokenizer_queries, tokenizer_sql
from tests.compare import DATA, connection, rows

QUERIES, SQL = tokenizer_queries.QUERIES, tokenizer_sql.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, con, name):
    got, expected = rows(QUERIES[name](spark, DATA).toPandas()), rows(con.execute(SQL[name]).df())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_works_without_llm(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
