"""Every registered query against its oracle SQL, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.parity import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    first = entry(spark).first()
    assert first["counts"] > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_result(spark, con, sf, name):
    assert difference(spark, con, queries()[name], oracle_sql()[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, sf, name):
    frame = queries()[name](spark, sf)
    assert frame.columns
    assert frame.take(1)
