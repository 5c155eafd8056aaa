"""Every query with SQL agrees with DuckDB over the smallest tables; the others run and are held to plain versions elsewhere."""

import pytest

import __spark_entry__ as entry_module
from inkwell.queries import ORACLE_SQL, QUERIES

from .oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = connect(SF)
    yield made
    made.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


#: The smallest tables hold no attributed quote and no stated day; their operators are tested on planted texts.
EMPTY = {"attributed_quotes", "event_timelines"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    """Values are held in the other modules; here a query runs over its tables and gives rows."""
    df = QUERIES[name](spark, SF)
    assert df.columns and (df.count() > 0) == (name not in EMPTY)


def test_entry_has_a_stable_schema(spark):
    first, second = entry_module.entry(spark), entry_module.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
