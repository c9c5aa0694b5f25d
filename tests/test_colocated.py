"""Tables staged in buckets of one key are joined and counted without a shuffle."""

import pytest

from offerloom.plans import prepare
from offerloom.sources.campaign import from_star_schema
from offerloom.sources.tables import discard, stage_bucketed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_customer_tables_meet_without_an_exchange(spark, no_broadcast):
    data = from_star_schema(spark, FOLDER)
    activity = prepare.customer_activity(prepare.customer_tables(data, 5))
    rows = activity.collect()
    plan = activity._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    apart = prepare.customer_activity(prepare.CustomerTables(data.impressions, data.transactions, data.demographics))
    assert sorted(rows) == sorted(apart.collect())


def test_one_file_per_bucket_and_discard(spark):
    df = spark.range(1000).selectExpr("id", "id % 37 as key", "cast(null as string) as nothing")
    staged = stage_bucketed(df, "numbers", "key", 4)
    assert staged.columns == df.columns and staged.count() == 1000 and len(staged.inputFiles()) <= 4
    assert stage_bucketed(df.limit(0), "none", "key", 4).count() == 0
    folder = staged.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    discard(staged)
    import os

    assert not os.path.exists(folder)
