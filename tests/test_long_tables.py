"""Steps that keep all groups of a task in memory get tasks of a bounded number of rows; encoders stage what they read."""

import datetime

import pytest
from pyspark.sql import functions as F

from offerloom.plans import catalog, prepare
from offerloom.sources import campaign
from offerloom.sources.tables import deal_long


@pytest.fixture
def star(spark, tmp_path):
    """Star tables of 900 lines, made here."""
    day = datetime.date(1995, 1, 1)
    tables = {
        "customer": ([(i, i % 25, ["BUILDING", "MACHINERY"][i % 2]) for i in range(20)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(i, f"B{i % 3}", i, f"T{i % 4}") for i in range(30)], "p_partkey long, p_brand string, p_size int, p_type string"),
        "orders": ([(i, i % 20, day + datetime.timedelta(9 * i)) for i in range(250)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": (
            [(i % 250, i % 7, i * 11 % 30, 1.0 + i % 5, 10.0 + i, 0.1, 0.05, "RN"[i % 2]) for i in range(900)],
            "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
            "l_tax double, l_returnflag string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_tasks_follow_the_rows(spark):
    rows = spark.range(9000).select((F.col("id") % 4500).alias("a"), (F.col("id") % 3).alias("b"))
    found = deal_long(rows, 9000, rows.columns, rows_per_task=100).distinct()
    counts = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(counts) == 90 and max(counts) < 200
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.distinct().collect()))


def test_short_tables_are_not_dealt_out(spark):
    rows = spark.range(800)
    assert deal_long(rows, 800, ["id"], rows_per_task=100) is rows


def test_star_tables_hold_the_same_rows_when_dealt_out(spark, star, monkeypatch):
    plain = campaign.from_star_schema(spark, star)
    monkeypatch.setattr(campaign, "deal_long", lambda df, n, keys: deal_long(df, n, keys, rows_per_task=20))
    dealt = campaign.from_star_schema(spark, star)
    for name in ("coupon_items", "impressions"):
        left, right = getattr(plain, name), getattr(dealt, name)
        assert right.rdd.getNumPartitions() == 45
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_encoders_stage_the_columns_they_read(spark, star, monkeypatch):
    staged = []
    monkeypatch.setattr(catalog, "stage", lambda df, *a: staged.append(df.columns) or df)
    catalog.QUERIES["q_onehot_full"](spark, star)
    catalog.QUERIES["q_label_encode"](spark, star)
    assert staged == [["id", *prepare.ONE_HOT], ["id", *prepare.CODES]]
