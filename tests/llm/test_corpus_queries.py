"""Every query of the subpackage against its SQL, or a plain version, on the smallest data."""

from __future__ import annotations

import pytest

from presencia.llm.queries import R
from tests.llm.brute import shared_runs
from tests.oracle import DATA, compare, views

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", list(R.queries))
def test_query_as_by_sql(spark, con, name):
    assert compare(spark, name, R.queries[name], R.sql.get(name), SF, con) == ""


def test_leaks_of_the_tables(spark, con):
    docs = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    items = dict(con.sql("SELECT item_id, text FROM eval_items").fetchall())
    found = {tuple(r) for r in R.queries["p8_found"](spark, SF).select("item_id", "doc_id").collect()}
    assert found == shared_runs(docs, items)


def test_entry_adds_these_queries():
    import __spark_entry__ as entry

    assert set(R.queries) <= set(entry.queries())
