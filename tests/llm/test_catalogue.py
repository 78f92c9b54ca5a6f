"""Every query of the folder runs on the tables, on empty ones and on dirty ones."""

import pytest

from segmenta.llm import catalogue

from tests.compare import differences

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert not differences(spark, QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_dirty_tables(spark, dirty_dir, name):
    QUERIES[name](spark, dirty_dir).collect()
