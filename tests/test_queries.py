"""Every registered query runs; every one with SQL gives the same rows as the SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import first_difference, oracle_connection, oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"
MODEL_QUERIES = sorted(set(queries()) - set(oracle_sql()))


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    got = spark_rows(queries()[name](spark, FOLDER))
    assert first_difference(got, oracle_rows(connection, oracle_sql()[name])) is None
    assert got[1]


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_query_gives_rows(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 150 and "age_range" in df.columns


def test_left_joins_keep_the_number_of_rows(spark):
    got = {name: queries()[name](spark, FOLDER).count() for name in ("q_scan_impressions", "q_star_join", "q_feature_table")}
    assert len(set(got.values())) == 1
