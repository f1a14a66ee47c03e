import pytest

import __spark_entry__ as entry
from tablewarden.queries import ORACLES, QUERIES
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
