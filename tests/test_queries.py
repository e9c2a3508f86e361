"""Every query of the library against its SQL, on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, views

SF = str(DATA / "sf0.001")
CORE = [n for r in (__import__(m, fromlist=["R"]).R for m in entry.MODULES) for n in r.queries]


@pytest.fixture(scope="module")
def con():
    return views(SF)


def test_names_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.MODULES and len(CORE) == len(set(CORE))


def test_entry(spark):
    assert entry.entry(spark).columns == ["src_table", "load_no", "reason", "n_rows"]


@pytest.mark.parametrize("name", CORE)
def test_query_as_by_sql(spark, con, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF, con) == ""
