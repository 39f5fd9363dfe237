"""Every query that has SQL gives the same values as the SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences, duck
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_values(name, spark, con):
    got = queries()[name](spark, SMALL).toPandas()
    assert differences(got, con.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_model_queries_give_rows(name, spark):
    rows = queries()[name](spark, SMALL).toPandas()
    assert len(rows)
    if {"rank", "userId", "movieId"} <= set(rows):
        assert not rows.duplicated(["userId", "movieId"]).any()
        assert rows["rank"].between(1, 10).all()


def test_entry(spark):
    assert entry(spark).count() == 20


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
