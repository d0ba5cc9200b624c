"""Every registered query of the lakehouse against its DuckDB twin, and the entry module."""

import pytest
from conftest import same

from brackwater.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
