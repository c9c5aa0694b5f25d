"""Model rows are read in tasks of a bounded number of rows, whatever the split size of the session."""

import pytest
from pyspark.sql import functions as F

from offerloom.models import boosting
from offerloom.plans import modelling
from offerloom.session import JIT_LIMIT, compile_wide_rows
from offerloom.sources.tables import stage_for_fits


def rows_of_tasks(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_no_task_reads_more_rows_than_stated(spark):
    rows = spark.range(40_000).selectExpr("id", "id % 2 as side", "id * 3 as x").coalesce(1)
    small = stage_for_fits(rows, "fit_tasks", ["side"], rows_per_task=1000)
    counts = rows_of_tasks(small)
    assert max(counts) <= 1000 and sum(counts) == 40_000
    assert small.columns == rows.columns and small.exceptAll(rows).isEmpty() and rows.exceptAll(small).isEmpty()


def test_short_tables_stay_in_their_session(spark):
    rows = spark.range(100).selectExpr("id", "id % 2 as side")
    assert stage_for_fits(rows, "fit_tasks", ["side"]).sparkSession is spark


def test_settings_of_the_session_go_along(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        small = stage_for_fits(spark.range(9000), "fit_tasks", rows_per_task=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert small.sparkSession is not spark
    assert small.sparkSession.conf.get("spark.sql.shuffle.partitions") == "5"


def test_fits_keep_no_second_map_of_rows():
    assert not boosting.classifier(boosting.PARAMS_B).getCacheNodeIds()


def test_model_rows_are_made_by_compiled_methods(spark):
    """A projection of very many columns is no single method that the JVM would interpret."""
    compile_wide_rows(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == JIT_LIMIT
    wide = spark.range(100).select(*[(F.col("id") % n).cast("double").alias(f"c{n}") for n in range(1, 301)])
    assert wide.where("c7 = 3").count() == 14
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "500")
    compile_wide_rows(spark)  # a lower setting stays
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "500"
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_model_table_sets_the_limit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(modelling, "compile_wide_rows", seen.append)
    monkeypatch.setattr(modelling, "with_absent_levels", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        modelling.model_table(spark.range(1))
    assert seen == [spark]
