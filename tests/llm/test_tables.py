"""The registered corpus queries over the smallest test tables, beside their SQL."""

import pytest
from compare import SF, connect, rows, sql_rows

from webarc.llm import queries as q

SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert rows(q.queries()[name](spark, SF)) == sql_rows(con, SQL[name])


def test_ten_operators():
    assert {int(n[2:].split("_")[0]) for n in q.queries()} == set(range(1, 11))
