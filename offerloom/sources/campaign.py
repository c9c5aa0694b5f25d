"""The campaign data set: where its tables come from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.functions.dates import parse_date_or_fail
from offerloom.operators.combine import split_by_source, union_tagged
from offerloom.sources.tables import deal_long, read_csv, read_parquet, stage

TRAIN_CAMPAIGNS = 18


@dataclass(frozen=True)
class CampaignData:
    """``impressions`` holds train and test rows, told apart by ``source``."""

    impressions: DataFrame
    campaigns: DataFrame
    coupon_items: DataFrame
    items: DataFrame
    demographics: DataFrame
    transactions: DataFrame

    @property
    def train(self) -> DataFrame:
        return split_by_source(self.impressions).train

    @property
    def test(self) -> DataFrame:
        return split_by_source(self.impressions).test

    @property
    def template(self) -> DataFrame:
        """The ids a submission has to answer."""
        return self.test.select("id")

    def with_staged_impressions(self) -> CampaignData:
        return replace(self, impressions=stage(self.impressions, "impressions", ["source"]))


def from_csv(
    spark: SparkSession,
    folder: str,
    campaign_dates: str = "dd/MM/yy",
    transaction_dates: str = "yyyy-MM-dd",
) -> CampaignData:
    """Seven CSV files in one folder, dates parsed with the stated formats; a date that does not fit stops the read."""

    def table(name: str, schema):
        return read_csv(spark, f"{folder}/{name}.csv", schema)

    campaigns = table("campaign_data", schemas.CAMPAIGN).withColumns(
        {
            "start_date": parse_date_or_fail(F.col("start_date"), campaign_dates),
            "end_date": parse_date_or_fail(F.col("end_date"), campaign_dates),
        }
    )
    transactions = table("customer_transaction_data", schemas.TRANSACTION).withColumn(
        "date", parse_date_or_fail(F.col("date"), transaction_dates)
    )
    return CampaignData(
        impressions=union_tagged(
            {"train": table("train", schemas.TRAIN), "test": table("test", schemas.TEST)}
        ),
        campaigns=campaigns,
        coupon_items=table("coupon_item_mapping", schemas.COUPON_ITEM),
        items=table("item_data", schemas.ITEM),
        demographics=table("customer_demographics", schemas.DEMOGRAPHICS),
        transactions=transactions,
    )


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a submission template; the values in it only show the format."""
    return read_csv(spark, path, schemas.SUBMISSION).select("id")


def impression_id(customer: Column, coupon: Column, campaign: Column) -> Column:
    """One number per impression: ten digits for coupon and campaign, the rest for the customer.

    A coupon or campaign that does not fit stops the query, and so does an overflow, so that two
    impressions never share an id.
    """
    fits = coupon.between(0, 10**8 - 1) & campaign.between(0, 99)
    number = customer.cast("long") * F.lit(10**10) + coupon * 100 + campaign
    return F.when(fits, number).otherwise(F.raise_error(F.lit("coupon or campaign does not fit into the id")))


def from_star_schema(spark: SparkSession, folder: str) -> CampaignData:
    """Campaign tables derived from order and line-item tables in ``folder``.

    A campaign is a calendar quarter of orders, a coupon a supplier, an item a
    part; each (campaign, coupon, customer) that occurs is one impression.
    """

    def table(name: str) -> DataFrame:
        return read_parquet(spark, f"{folder}/{name}.parquet")

    orders = table("orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    campaign_id = ((F.year("date") - 1995) * 4 + F.quarter("date")).alias("campaign_id")
    lines = table("lineitem")
    n_lines = lines.count()  # read from the footers
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    in_train = F.col("campaign_id") <= TRAIN_CAMPAIGNS
    redeemed = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 2)).cast("int")
    offers = bought.select(
        campaign_id,
        F.col("l_suppkey").alias("coupon_id"),
        "customer_id",
        redeemed.alias("redeemed"),
    )
    offer_key = ["campaign_id", "coupon_id", "customer_id"]
    impressions = (
        deal_long(offers, n_lines, offer_key)
        .groupBy(*offer_key)
        .agg(F.max("redeemed").alias("redeemed"))
        .select(
            impression_id(F.col("customer_id"), F.col("coupon_id"), F.col("campaign_id")).alias("id"),
            "campaign_id",
            "coupon_id",
            "customer_id",
            F.when(in_train, F.col("redeemed")).alias("redemption_status"),
            F.when(in_train, "train").otherwise("test").alias("source"),
        )
    )

    campaigns = (
        orders.select(campaign_id, "date")
        .groupBy("campaign_id")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
        .select(
            "campaign_id",
            F.when(F.col("campaign_id") % 5 == 0, "X").otherwise("Y").alias("campaign_type"),
            "start_date",
            "end_date",
        )
    )

    pairs = lines.select(F.col("l_suppkey").alias("coupon_id"), F.col("l_partkey").alias("item_id"))
    coupon_items = deal_long(pairs, n_lines, pairs.columns).distinct()

    items = table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_size") % 5 == 0, "Local").otherwise("Established").alias("brand_type"),
        F.col("p_type").alias("category"),
    )

    nation = F.col("c_nationkey")
    ages = ["18-25", "26-35", "36-45", "46-55", "56-70", "70+"]
    age_range = F.element_at(F.array(*map(F.lit, ages)), (nation % 6 + 1).cast("int"))
    segment = F.col("c_mktsegment")
    demographics = (
        table("customer")
        .filter(F.col("c_custkey") % 2 == 0)
        .select(
            F.col("c_custkey").alias("customer_id"),
            age_range.alias("age_range"),
            F.when(segment.isin("BUILDING", "FURNITURE"), "Married")
            .when(segment == "MACHINERY", "Single")
            .alias("marital_status"),
            (nation % 2).alias("rented"),
            F.when(nation % 5 == 4, "5+").otherwise((nation % 5 + 1).cast("string")).alias("family_size"),
            F.when(nation % 4 == 3, "3+")
            .when(nation % 4 != 0, (nation % 4).cast("string"))
            .alias("no_of_children"),
            (nation % 12 + 1).alias("income_bracket"),
        )
    )

    price = F.col("l_extendedprice")
    transactions = bought.select(
        "date",
        "customer_id",
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"),
        price.alias("selling_price"),
        (F.lit(0.0) - price * F.col("l_discount")).alias("other_discount"),
        (F.lit(0.0) - price * F.col("l_tax")).alias("coupon_discount"),
    )
    return CampaignData(impressions, campaigns, coupon_items, items, demographics, transactions)
