"""Every registered query against its DuckDB statement on the smallest tables."""
import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    result = compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
