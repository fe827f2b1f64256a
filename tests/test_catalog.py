"""Every query with an oracle against DuckDB, and rows of the others."""

import pytest

from lodestone.plans.catalog import ORACLE_SQL, QUERIES

from .compare import connect, of_duck, of_spark


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, small, con, name):
    assert of_spark(QUERIES[name](spark, small)) == of_duck(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
