import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom import schemas, session
from offerloom.plans import prepare
from offerloom.sources import campaign, tables
from offerloom.sources.campaign import impression_id

FILES = {
    "train": "id,campaign_id,coupon_id,customer_id,redemption_status\n1,13,27,1,0\n2,13,28,2,1\n4,14,27,3,0\n",
    "test": "id,campaign_id,coupon_id,customer_id\n3,22,27,2\n5,22,99,1\n",
    "campaign_data": "campaign_id,campaign_type,start_date,end_date\n13,X,19/05/13,05/07/13\n14,Y,10/12/12,09/01/13\n22,X,16/09/13,18/10/13\n",
    "coupon_item_mapping": "coupon_id,item_id\n27,37\n27,75\n27,76\n28,75\n",
    "item_data": "item_id,brand,brand_type,category\n37,56,Local,Grocery\n75,11,Established,Dairy\n76,11,Established,Grocery\n",
    "customer_demographics": "customer_id,age_range,marital_status,rented,family_size,no_of_children,income_bracket\n"
    "1,70+,Married,0,2,,4\n3,36-45,,0,5+,3+,10\n",
    "customer_transaction_data": "date,customer_id,item_id,quantity,selling_price,other_discount,coupon_discount\n"
    "2012-01-02,1,37,1,35.26,-10.69,0.0\n2012-01-03,1,37,1,53.43,-13.89,0.0\n2012-01-02,2,75,2,106.5,-14.25,-1.0\n"
    "2012-05-01,3,76,1,10.0,0.0,0.0\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_csv_tables_join_into_one_row_per_impression(spark, folder):
    data = campaign.from_csv(spark, folder)
    rows = {r.id: r for r in prepare.star_join(data).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    one = rows[1]
    assert (one.start_date, one.end_date) == (dt.date(2013, 5, 19), dt.date(2013, 7, 5))
    # Modes are per column: the most frequent brand, type and category, the smallest of tied items.
    assert (one.item_id_x, one.brand, one.brand_type, one.category) == (37, 11, "Established", "Grocery")
    assert (one.trans_date, one.item_id_y, one.selling_price) == (dt.date(2012, 1, 2), 37, 44.345)
    # Customer 2 has no demographics and takes those of customer 1; children stay unknown and become 0.
    assert (rows[2].age_range, rows[2].marital_status, rows[2].no_of_children) == ("70+", "Married", "0")
    assert rows[4].marital_status == "Married" and rows[4].no_of_children == "3+"
    assert rows[3].redemption_status is None and rows[3].source == "test"
    assert rows[5].brand is None


def test_demographics_without_fill_and_with_cleaning(spark, folder):
    data = campaign.from_csv(spark, folder)
    open_ = {r.customer_id: r for r in prepare.customer_profile(data, "nofill").collect()}
    assert open_[2].age_range is None and open_[1].no_of_children is None
    clean = {r.customer_id: r for r in prepare.customer_profile(data, "unknown").collect()}
    assert clean[3].marital_status == "Unknown" and clean[3].family_size == "5" and clean[3].no_of_children == "3"


def test_feature_table_from_csv(spark, folder):
    rows = {r.id: r.asDict() for r in prepare.feature_table(campaign.from_csv(spark, folder)).collect()}
    assert rows[1]["campaign_duration"] == 47 and rows[1]["campaign_x"] == 1 and rows[1]["campaign_y"] == 0
    assert rows[4]["income_bracket_code"] == 1 and rows[4]["income_code_1"] == 1
    assert rows[1]["income_code_1"] == 0 and "income_code_0" not in rows[1]
    assert rows[5]["category_code"] is None and rows[5]["brand_type_est"] == 0
    assert not {"category", "start_date", "selling_price", "rented"} & set(rows[1])


def test_malformed_csv_stops_the_read(spark, tmp_path):
    (tmp_path / "train.csv").write_text("id,campaign_id,coupon_id,customer_id,redemption_status\nx,1,1,1,0\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        tables.read_csv(spark, str(tmp_path / "train.csv"), schemas.TRAIN).collect()


def test_csv_and_parquet_survive_a_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("redemption_status", T.DoubleType())])
    df = spark.createDataFrame([(1, 0.1), (2, 1 / 3), (3, None)], schema)
    tables.write_csv(df, str(tmp_path / "csv"), single_file=True)
    tables.write_parquet(df, str(tmp_path / "parquet"))
    expected = sorted(map(tuple, df.collect()))
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), schemas.SUBMISSION).collect())) == expected
    assert sorted(map(tuple, tables.read_parquet(spark, str(tmp_path / "parquet")).collect())) == expected


def test_template_holds_the_ids(spark, tmp_path):
    (tmp_path / "sample.csv").write_text("id,redemption_status\n3,0\n5,0\n")
    template = campaign.read_template(spark, str(tmp_path / "sample.csv"))
    assert template.columns == ["id"] and sorted(r.id for r in template.collect()) == [3, 5]


def test_staged_tables_keep_columns_and_prune_partitions(spark):
    df = spark.createDataFrame([("train", 1), ("test", 2)], "source string, id long")
    staged = tables.stage(df, "x", ["source"])
    assert staged.columns == ["source", "id"] and staged.dtypes == df.dtypes
    train = staged.filter("source = 'train'")
    assert [r.id for r in train.collect()] == [1]
    assert "PartitionFilters: [isnotnull(source" in train._jdf.queryExecution().executedPlan().toString()


def test_the_cluster_folder_is_used_and_required(tmp_path):
    values = {"spark.checkpoint.dir": str(tmp_path) + "/"}

    class Conf:
        def get(self, key, default=None):
            return values.get(key, default)

    class Context:
        master, applicationId = "spark://cluster:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert session.shared_folder(Session()) == str(tmp_path)
    values.clear()
    Context.master = "local[2]"
    assert "offerloom-" in session.shared_folder(Session()) == session.shared_folder(Session())
    Context.master = "spark://cluster:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_impression_ids_stay_apart_with_many_coupons(spark):
    keys = spark.range(2).select((F.col("id") + 1).alias("customer")).crossJoin(
        spark.range(9_990, 10_020).select(F.col("id").alias("coupon"))
    )
    ids = keys.select(impression_id(F.col("customer"), F.col("coupon"), F.lit(3)).alias("id"))
    assert ids.distinct().count() == 60
    far = spark.range(1).select(impression_id(F.lit(1), F.lit(10**8), F.lit(3)).alias("id"))
    with pytest.raises(Exception, match="does not fit"):
        far.collect()
