"""Every registered query against its SQL, on the medium tables."""

import pytest

from __spark_entry__ import entry
from bindings.compare import compare, connect
from bindings.registry import ENTRIES
from tests.conftest import MEDIUM

SQL = {name: e.sql for name, e in ENTRIES.items() if e.sql}


@pytest.fixture(scope="module")
def duck():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, MEDIUM, ENTRIES[name].query, SQL[name]) == ""


def test_every_query_has_sql():
    assert set(ENTRIES) - set(SQL) == {"m_model_errors"}


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 10
    assert [r.revenue for r in rows] == sorted((r.revenue for r in rows), reverse=True)


def test_no_doubles_are_left_unrounded():
    """A double hashed without rounding would differ by summation order."""
    con = connect(MEDIUM)
    for name, sql in SQL.items():
        types = {d[0]: str(d[1]) for d in con.execute(sql).description}
        for column, kind in types.items():
            if kind == "DOUBLE":
                assert f"AS {column}" in sql.split("* REPLACE", 1)[-1], (name, column)
