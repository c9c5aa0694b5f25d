"""From the raw tables to one encoded row per impression."""

from __future__ import annotations

from typing import Literal, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions import dates, levels, numeric
from offerloom.operators.aggregate import modes_by_key, profile_by_key
from offerloom.operators.encode import Levels, dummies, fit_levels, label_encode, short_levels
from offerloom.operators.joins import lookup
from offerloom.operators.ordered import forward_fill
from offerloom.sources.campaign import CampaignData
from offerloom.sources.tables import stage, stage_all, stage_bucketed

Demographics = Literal["ffill", "nofill", "unknown"]
DEMOGRAPHIC_COLUMNS = [
    "age_range",
    "marital_status",
    "rented",
    "family_size",
    "no_of_children",
    "income_bracket",
]
CODES = {
    "category": "category_code",
    "age_range": "age_range_code",
    "family_size": "family_size_code",
    "no_of_children": "no_of_children_code",
    "income_bracket": "income_bracket_code",
}
# Columns with one dummy per level, and the names of those not called like their level.
ONE_HOT = ["campaign_type", "brand_type", "marital_status"]
DUMMY_NAMES = {
    "X": "campaign_x",
    "Y": "campaign_y",
    "Established": "brand_type_est",
    "Local": "brand_type_loc",
}
# Prefix of the dummies made from each code column.
CODE_DUMMIES = {
    "category_code": "categ_code",
    "family_size_code": "family_code",
    "age_range_code": "age_range_code",
    "income_bracket_code": "income_code",
    "no_of_children_code": "no_child_code",
}


def impressions_with_campaign(data: CampaignData) -> DataFrame:
    return lookup(data.impressions, data.campaigns, "campaign_id")


def coupon_item_table(data: CampaignData) -> DataFrame:
    return lookup(data.coupon_items, data.items, "item_id").select(
        "coupon_id", "item_id", "brand", "brand_type", "category"
    )


def coupon_profile(data: CampaignData) -> DataFrame:
    """What a coupon is mostly about: the most frequent item, brand, type and category."""
    return modes_by_key(coupon_item_table(data), "coupon_id", ["item_id", "brand", "brand_type", "category"])


def customer_spend(data: CampaignData) -> DataFrame:
    """Usual date, item and quantity and mean amounts of each customer."""
    return profile_by_key(
        data.transactions,
        "customer_id",
        modes=["date", "item_id", "quantity"],
        means=["selling_price", "other_discount", "coupon_discount"],
    )


def customer_profile(data: CampaignData, demographics: Demographics = "ffill") -> DataFrame:
    """Spend and demographics of each customer that bought something.

    Not every customer has demographics. ``nofill`` leaves those NULL, ``ffill``
    takes the values of the customer before (by id), and ``unknown`` cleans the
    demographics first and then fills forward what the join left open.
    """
    people = data.demographics
    if demographics == "unknown":
        people = people.withColumns(levels.impute_demographics())
    joined = lookup(customer_spend(data), people, "customer_id")
    if demographics == "nofill":
        return joined
    filled = forward_fill(joined, "customer_id", DEMOGRAPHIC_COLUMNS)
    return filled.withColumn("no_of_children", levels.fill_level(F.col("no_of_children"), "0"))


def star_join(data: CampaignData, demographics: Demographics = "ffill") -> DataFrame:
    """One row per impression with its campaign, coupon profile and customer profile.

    The three lookup tables are staged first: their sizes are then known before the
    impressions are read, so small ones are broadcast without shuffling impressions.
    Item columns of coupon and customer are told apart as item_id_x and item_id_y.
    """
    tables = stage_all(
        data.impressions.sparkSession,
        {
            "campaigns": lambda: data.campaigns,
            "coupons": lambda: coupon_profile(data),
            "customers": lambda: customer_profile(data, demographics),
        },
    )
    rows = lookup(data.impressions, tables["campaigns"], "campaign_id")
    rows = lookup(rows, tables["coupons"], "coupon_id", {"item_id": "item_id_x"})
    return lookup(rows, tables["customers"], "customer_id", {"item_id": "item_id_y", "date": "trans_date"})


def clean_levels(merged: DataFrame) -> DataFrame:
    return merged.withColumn("no_of_children", levels.replace_level(F.col("no_of_children"), "3+", "3"))


def fit_categories(merged: DataFrame) -> Levels:
    """The levels of all categorical columns, found in one pass."""
    return fit_levels(merged, [*CODES, *ONE_HOT, "rented"])


def encode_categories(merged: DataFrame, found: Levels) -> DataFrame:
    """Codes and plain dummies instead of the categorical columns."""
    columns = {}
    for column in ONE_HOT:
        columns |= dummies(column, short_levels(found, column), names=DUMMY_NAMES)
    columns |= dummies("rented", short_levels(found, "rented"), prefix="rented", drop_first=True)
    coded = label_encode(merged, CODES, found)
    return coded.withColumns(columns).drop(*CODES, *ONE_HOT, "rented")


def add_durations(df: DataFrame) -> DataFrame:
    start = F.col("start_date")
    days = {
        "campaign_duration": dates.duration_days(start, F.col("end_date")),
        "trans_duration": dates.duration_days(start, F.col("trans_date")),
    }
    return df.withColumns(days).drop("start_date", "end_date", "trans_date")


def add_logs(df: DataFrame) -> DataFrame:
    logs = {
        "selling_price_log": numeric.log_price(F.col("selling_price")),
        "other_discount_log": numeric.log_discount(F.col("other_discount")),
        "coupon_discount_log": numeric.log_discount(F.col("coupon_discount")),
    }
    return df.withColumns(logs).drop("selling_price", "other_discount", "coupon_discount")


def add_code_dummies(df: DataFrame, found: Levels) -> DataFrame:
    """Dummies for the coded columns, lowest code left out; n levels have the codes 0 to n-1."""
    columns = {}
    for column, code in CODES.items():
        known = range(len(short_levels(found, column)))
        columns |= dummies(code, known, prefix=CODE_DUMMIES[code], drop_first=True)
    return df.withColumns(columns)


def feature_table(data: CampaignData, demographics: Demographics = "ffill") -> DataFrame:
    """The encoded table. The merged rows are staged, as they are read twice: for levels and for rows."""
    merged = clean_levels(stage(star_join(data, demographics), "merged", ["source"]))
    found = fit_categories(merged)
    return add_code_dummies(add_logs(add_durations(encode_categories(merged, found))), found)


class CustomerTables(NamedTuple):
    """Tables that lie side by side: the same customers in the same buckets."""

    impressions: DataFrame
    transactions: DataFrame
    demographics: DataFrame


def customer_tables(data: CampaignData, buckets: int | None = None) -> CustomerTables:
    """Stage what hangs on customers in buckets by customer_id, once for all joins and counts by customer."""
    return CustomerTables(
        *(
            stage_bucketed(df, name, "customer_id", buckets)
            for name, df in (("impressions", data.impressions), ("transactions", data.transactions), ("demographics", data.demographics))
        )
    )


def customer_activity(tables: CustomerTables) -> DataFrame:
    """Purchases, offers and income bracket of every customer that bought something: no shuffle on bucketed tables."""
    bought = tables.transactions.groupBy("customer_id").agg(
        F.count("*").alias("n_transactions"), F.sum("quantity").cast("bigint").alias("quantity")
    )
    offered = tables.impressions.groupBy("customer_id").agg(
        F.count("*").alias("n_offers"), F.count_if(F.col("source") == "test").alias("n_test_offers")
    )
    people = tables.demographics.select("customer_id", "income_bracket")
    both = lookup(lookup(bought, offered, "customer_id"), people, "customer_id")
    return both.fillna(0, ["quantity", "n_offers", "n_test_offers"])
