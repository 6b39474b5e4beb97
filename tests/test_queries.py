"""Every registered query of the engine's own operators, held against its SQL where there is one."""

import pytest
from compare import SF, connect, rows, sql_rows

from webarc.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    got = rows(plans.queries()[name](spark, SF))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])
    else:
        assert got[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(plans.queries())
