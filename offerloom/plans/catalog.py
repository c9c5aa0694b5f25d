"""The registered queries: each takes (spark, folder) and returns a DataFrame over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from offerloom.functions import dates, levels, numeric
from offerloom.functions.hashing import seeded_uniform
from offerloom.models import boosting, rounds, selection
from offerloom.models.boosting import PARAMS_A, PARAMS_B, PARAMS_B_LEAVES, TreeParams
from offerloom.operators import aggregate, combine, dictionary, encode, frequent, key_sketches, metrics, ordered, profile, sets, splits
from offerloom.operators.joins import lookup
from offerloom.plans import modelling, prepare
from offerloom.plans.modelling import ModelTable
from offerloom.plans.prepare import CODES
from offerloom.session import shared_folder
from offerloom.sources import ordered_files, rejects
from offerloom.sources.campaign import CampaignData, from_star_schema
from offerloom.sources.tables import read_parquet, remove_folder, stage, stage_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The whole job is PARAMS_A, PARAMS_B and ten folds. The smaller settings are those of queries that search, check or write.
FOLDS = 10
QUERY_PARAMS_A = replace(PARAMS_A, trees=5, depth=5)
QUERY_PARAMS_B = replace(PARAMS_B, trees=5)
QUERY_FOLDS = 3


def query(fn: Callable[[CampaignData], DataFrame]) -> Callable[[CampaignData], DataFrame]:
    """Register a query over the campaign tables."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(from_star_schema(spark, folder))
    return fn


def table_query(fn: Query) -> Query:
    """Register a query that reads other tables."""
    QUERIES[fn.__name__] = fn
    return fn


def hash_scores(*names: str) -> dict[str, Column]:
    """Made-up but repeatable scores per row, so that metrics can be checked without a model."""
    return {name: seeded_uniform(F.col("id"), splits.SEED, name) for name in names}


def open_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Whole-number columns with gaps as doubles, the form in which other tools hold them."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# Scans, staging, combining


@query
def q_scan_impressions(data):
    return open_numbers(data.impressions, combine.TARGET)


@query
def q_stage_roundtrip(data):
    return open_numbers(stage(data.impressions, "roundtrip", ["source"]), combine.TARGET)


@query
def q_union_train_test(data):
    return open_numbers(combine.union_tagged({"train": data.train, "test": data.test}), combine.TARGET)


@query
def q_split_source_train(data):
    return combine.split_by_source(data.impressions).train


@query
def q_split_source_test(data):
    return combine.split_by_source(data.impressions).test


@query
def q_string_columns(data):
    merged = stage(prepare.star_join(data), "merged")
    names = combine.string_columns(merged)
    filled = merged.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "n_filled")
    return filled.join(profile.unique_counts(merged, names), "column_name")


# Filters


@query
def q_missing_children_by_family(data):
    return profile.value_counts(data.demographics.filter(F.col("no_of_children").isNull()), "family_size")


@query
def q_unknown_marital_with_children(data):
    cleaned = levels.impute_demographics()
    people = data.demographics.withColumn("no_of_children", cleaned["no_of_children"])
    return people.filter(F.col("marital_status").isNull() & (F.col("no_of_children") >= "1")).select(
        "customer_id", "family_size", "no_of_children"
    )


@table_query
def q_negative_campaign(spark, folder):
    """Windows from order to shipment that end before they start."""
    orders = read_parquet(spark, f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("start_date")
    )
    lines = read_parquet(spark, f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("end_date")
    )
    start, end = F.col("start_date"), F.col("end_date")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter(dates.ends_before_start(start, end))
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("coupon_id"),
            "start_date",
            "end_date",
            dates.signed_days(start, end).alias("days"),
        )
    )


def _impression_dates(data: CampaignData) -> DataFrame:
    """id, label side, campaign window and usual transaction date of each impression."""
    tables = stage_all(
        data.impressions.sparkSession,
        {
            "campaigns": lambda: data.campaigns.select("campaign_id", "start_date", "end_date"),
            "usual_date": lambda: aggregate.mode_by_key(data.transactions, "customer_id", "date"),
        },
    )
    rows = data.impressions.select("id", "campaign_id", "customer_id")
    rows = lookup(rows, tables["campaigns"], "campaign_id")
    return lookup(rows, tables["usual_date"], "customer_id", {"date": "trans_date"})


@query
def q_trans_before_start(data):
    rows = _impression_dates(data)
    early = dates.ends_before_start(F.col("start_date"), F.col("trans_date"))
    return rows.select("id", "start_date", "trans_date", early.alias("before_start"))


# Joins and profiles


@query
def q_join_campaign(data):
    staged = replace(data, campaigns=stage(data.campaigns, "campaigns"))
    return open_numbers(prepare.impressions_with_campaign(staged), combine.TARGET)


@query
def q_join_coupon_item(data):
    return prepare.coupon_item_table(data)


@query
def q_mode_coupon_profile(data):
    return prepare.coupon_profile(data)


@query
def q_join_coupon_profile(data):
    profiles = stage(prepare.coupon_profile(data), "coupon_profile")
    return open_numbers(lookup(data.impressions, profiles, "coupon_id"), combine.TARGET)


@query
def q_mode_customer_all(data):
    columns = combine.columns_except(data.transactions, ["customer_id"])
    return aggregate.modes_by_key(data.transactions, "customer_id", columns)


@query
def q_mode_two_stage(data):
    return aggregate.mode_by_key(data.transactions, "customer_id", "item_id")


@query
def q_customer_profile(data):
    return prepare.customer_spend(data)


@query
def q_customer_nofill(data):
    return open_numbers(prepare.customer_profile(data, "nofill"), "rented", "income_bracket")


@query
def q_customer_ffill(data):
    return prepare.customer_profile(data, "ffill")


@query
def q_customer_unknown(data):
    return prepare.customer_profile(data, "unknown")


@query
def q_customer_activity(data):
    """Three tables by customer, joined where they lie."""
    activity = prepare.customer_activity(prepare.customer_tables(data))
    return open_numbers(activity, "income_bracket")


@table_query
def q_ffill_scalable(spark, folder):
    """Last known price and priority of finished orders, in order of the order key."""
    finished = F.col("o_orderstatus") == "F"
    orders = read_parquet(spark, f"{folder}/orders.parquet").select(
        "o_orderkey",
        F.when(finished, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(finished, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return ordered.forward_fill(orders, "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query
def q_star_join(data):
    return open_numbers(prepare.star_join(data, "ffill"), combine.TARGET, "rented", "income_bracket")


@query
def q_star_join_nofill(data):
    return open_numbers(prepare.star_join(data, "nofill"), combine.TARGET, "rented", "income_bracket")


# Profiling


def _tables(data: CampaignData) -> dict[str, DataFrame]:
    impressions = stage(data.impressions, "impressions", ["source"])
    split = combine.split_by_source(impressions)
    return {
        "train": split.train,
        "test": split.test,
        "campaign": data.campaigns,
        "coupon_item": data.coupon_items,
        "item": data.items,
        "demographics": data.demographics,
        "transactions": data.transactions,
    }


@query
def q_row_counts(data):
    return profile.row_counts(_tables(data))


@query
def q_null_profile(data):
    return profile.table_infos(_tables(data))


@query
def q_nunique_profile(data):
    tables = _tables(data)
    keys = ["campaign_id", "coupon_id", "customer_id"]
    wanted = {
        "train": ["id", *keys],
        "test": ["id", *keys],
        "campaign": ["campaign_id", "campaign_type"],
        "coupon_item": ["coupon_id", "item_id"],
        "item": ["item_id", "brand", "brand_type", "category"],
        "demographics": ["customer_id"],
        "transactions": ["customer_id"],
    }
    return profile.unique_count_tables({name: (tables[name], c) for name, c in wanted.items()})


@query
def q_value_counts(data):
    return profile.level_counts(data.demographics, prepare.DEMOGRAPHIC_COLUMNS).unionByName(
        profile.level_counts(prepare.coupon_item_table(data), ["brand", "brand_type", "category"])
    )


@query
def q_class_distribution(data):
    return profile.value_shares(data.train, combine.TARGET)


@query
def q_positive_rate(data):
    return profile.positive_rate(data.train, combine.TARGET)


# Place of each key in an impression id: divisor and span.
ID_PARTS = [("coupon_id", 100, 10**8), ("customer_id", 10**10, 10**9), ("campaign_id", 1, 100)]
AMOUNTS = ["selling_price", "other_discount", "coupon_discount"]


@query
def q_describe(data):
    report = profile.describe(data.transactions, ["customer_id", "item_id", "quantity", *AMOUNTS])
    places = {"mean": 4, "std": 4} | dict.fromkeys(["min", "q25", "q50", "q75", "max"], 8)
    return report.withColumns({c: F.round(c, n) for c, n in places.items()})


@query
def q_quantile(data):
    report = ordered.quantiles(data.transactions, ["quantity", *AMOUNTS], {"q10": 0.1, "q90": 0.9})
    return report.withColumns({c: F.round(c, 8) for c in ("q10", "q90")})


@query
def q_skewness(data):
    price = F.col("selling_price")
    report = profile.skewness_table(
        data.transactions, {"selling_price": price, "selling_price_log": numeric.log_price(price)}
    )
    return report.withColumn("skewness", F.round("skewness", 6))


@query
def q_corr(data):
    scores = stage(data.test.select(*[c.alias(n) for n, c in hash_scores("score_a", "score_b").items()]), "scores")
    report = profile.correlations(data.transactions, AMOUNTS).unionByName(
        profile.correlations(scores, ["score_a", "score_b"])
    )
    return report.withColumn("corr", F.round("corr", 6))


@query
def q_histogram(data):
    values = {
        "selling_price": (F.col("selling_price"), 50),
        "other_discount_log": (numeric.log_discount(F.col("other_discount")), 50),
        "quantity": (F.col("quantity"), 10),
    }
    return profile.histograms(data.transactions, values).withColumn("bin_from", F.round("bin_from", 6))


@query
def q_category_counts(data):
    return profile.category_counts(prepare.coupon_item_table(data), "category")


# Sets and sorting


@query
def q_sorted_distinct(data):
    return sets.sorted_distinct(data.train, "coupon_id")


@query
def q_campaign_levels(data):
    """Campaigns offered, and how the offers and the campaigns spread over them and their types."""
    offered = sets.sorted_distinct(data.train, "campaign_id").select(
        F.lit("offered").alias("column_name"), F.col("campaign_id").cast("string").alias("level"), F.lit(1).cast("bigint").alias("n")
    )
    return combine.union_all(
        [offered, profile.level_counts(data.train, ["campaign_id"]), profile.level_counts(data.campaigns, ["campaign_type"])]
    )


@query
def q_topk_items(data):
    return combine.top_rows(profile.value_counts(data.transactions, "item_id"), ["n"], 15, ["item_id"])


@query
def q_frequent_items(data):
    """The rows of q_topk_items without a shuffle of all items."""
    return frequent.top_values(data.transactions, "item_id", 15)


@query
def q_frequent_categories(data):
    return frequent.top_values(prepare.coupon_item_table(data), "category", 10)


def _key_sets(data: CampaignData, operation) -> DataFrame:
    impressions = stage(data.impressions.select("id", "coupon_id", "customer_id", "source"), "keys", ["source"])
    train, test = (impressions.filter(F.col("source") == tag) for tag in ("train", "test"))
    return combine.union_all(
        operation(train, test, key).select(F.lit(key).alias("key_name"), F.col(key).alias("key_value"))
        for key in ("id", "coupon_id", "customer_id")
    )


@query
def q_ids_only_train(data):
    return _key_sets(data, sets.keys_only_in)


@query
def q_ids_common(data):
    return _key_sets(data, sets.keys_in_both)


@query
def q_key_set_sizes(data):
    """Train keys and test keys, sketched apart: sizes, overlaps and differences."""
    spark = data.train.sparkSession
    left, right = _own_folder(spark, "train-keys"), _own_folder(spark, "test-keys")
    columns = ["campaign_id", "coupon_id", "customer_id"]
    key_sketches.store_part(data.train, columns, left, "all")
    key_sketches.store_part(data.test, columns, right, "all")
    return key_sketches.set_sizes(spark, left, right)


@query
def q_customer_overlap(data):
    return sets.overlap_size(data.transactions, data.demographics, "customer_id")


# Scalar functions


@table_query
def q_parse_dates(spark, folder):
    orders = read_parquet(spark, f"{folder}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    texts = orders.select(
        "o_orderkey",
        F.date_format(day, "dd/MM/yyyy").alias("long_text"),
        F.date_format(day, "dd/MM/yy").alias("short_text"),
    )
    long = F.col("long_text")
    return texts.select(
        "o_orderkey",
        dates.parse_date(long, "dd/MM/yyyy").alias("day_first"),
        dates.parse_date_month_first(long, "MM/dd/yyyy", "dd/MM/yyyy").alias("month_first"),
        dates.parse_date(F.col("short_text"), "dd/MM/yy").alias("short_year"),
        dates.parse_date(long, "yyyy-MM-dd").isNull().alias("other_format_fails"),
    )


@query
def q_durations(data):
    rows = _impression_dates(data)
    start = F.col("start_date")
    return rows.select(
        "id",
        dates.duration_days(start, F.col("end_date")).alias("campaign_duration"),
        dates.duration_days(start, F.col("trans_date")).alias("trans_duration"),
    )


@query
def q_date_parts(data):
    rows = _impression_dates(data)
    parts = {k: v for c in ("start_date", "end_date", "trans_date") for k, v in dates.date_parts(c).items()}
    return rows.select("id", *[part.alias(name) for name, part in parts.items()])


@query
def q_log_price(data):
    price = F.col("selling_price")
    return data.transactions.select(
        "customer_id", "item_id", "selling_price", F.round(numeric.log_price(price), 6).alias("selling_price_log")
    )


@query
def q_log_discounts(data):
    logs = [
        F.round(numeric.log_discount(F.col(c)), 6).alias(f"{c}_log") for c in ("other_discount", "coupon_discount")
    ]
    return data.transactions.select("customer_id", "item_id", *logs)


@query
def q_impute_demographics(data):
    return data.demographics.withColumns(levels.impute_demographics())


@query
def q_blend(data):
    scored = data.test.select("id").withColumns(hash_scores("score_a", "score_b"))
    return scored.withColumn("score", numeric.blend([F.col("score_a"), F.col("score_b")], [0.5, 0.5]))


# Encoders


def _merged(data: CampaignData, columns: Sequence[str]) -> DataFrame:
    """All merged rows, staged with the columns that are encoded: what no encoder reads is not carried through the joins."""
    return stage(prepare.clean_levels(prepare.star_join(data)).select("id", *columns), "merged")


@query
def q_label_encode(data):
    return encode.label_encode(_merged(data, list(CODES)), CODES).select("id", *CODES.values())


@query
def q_onehot_full(data):
    merged = _merged(data, prepare.ONE_HOT)
    found = encode.fit_levels(merged, prepare.ONE_HOT)
    made = {}
    for column in prepare.ONE_HOT:
        made |= encode.dummies(column, encode.short_levels(found, column), prefix=column)
    return merged.select("id", *[value.alias(name) for name, value in made.items()])


@query
def q_onehot_drop_first(data):
    people = data.demographics.withColumns(levels.impute_demographics())
    prefixes = {"rented": "rented", "age_range": "age", "no_of_children": "children", "income_bracket": "income"}
    found = encode.fit_levels(people, list(prefixes))
    made = {}
    for column, prefix in prefixes.items():
        made |= encode.dummies(column, encode.short_levels(found, column), prefix=prefix, drop_first=True)
    return people.select("customer_id", *[value.alias(name) for name, value in made.items()])


@query
def q_category_bins(data):
    items = encode.label_encode(data.items, {"brand": "brand_code"})
    return items.select("item_id", encode.category_bins(F.col("brand_code"), [3, 7]).alias("brand_bin"))


@query
def q_code_table(data):
    """Codes of all items: the way that also holds for columns with very many levels."""
    return encode.code_table(data.transactions, "item_id", "item_code")


@query
def q_dictionary_versions(data):
    """Codes fitted on the demographics, and those that the transactions add behind them."""
    spark = data.transactions.sparkSession
    path = _own_folder(spark, "dictionary")
    dictionary.fit_dictionary(data.demographics, ["customer_id", "age_range"], path)
    dictionary.append_levels(data.transactions, ["customer_id"], path)
    return dictionary.read_dictionary(spark, path)


@query
def q_dictionary_unknown(data):
    """What a dictionary of the demographics does not know of the transactions, and the codes it gives."""
    path = _own_folder(data.transactions.sparkSession, "dictionary")
    dictionary.fit_dictionary(data.demographics, ["customer_id"], path)
    unknown = dictionary.unknown_levels(data.transactions, ["customer_id"], path)
    coded = dictionary.encode(data.transactions.select("customer_id"), {"customer_id": "code"}, path, "other")
    sums = coded.agg(
        F.count_if(F.col("code") == dictionary.OTHER).alias("n_other"), F.sum("code").alias("sum_codes"), F.max("code").alias("max_code")
    )
    return stage(unknown, "unknown").join(F.broadcast(sums))  # one row each


@query
def q_feature_table(data):
    features = open_numbers(prepare.feature_table(data), combine.TARGET)
    return features.withColumns({c: F.round(c, 6) for c in features.columns if c.endswith("_log")})


# Splits


@query
def q_holdout_split(data):
    return splits.holdout_split(data.train.select("id"))


@query
def q_kfold(data):
    return splits.kfold(data.train.select("id"))


@query
def q_kfold_exact(data):
    return splits.kfold_exact(stage(data.train.select("id"), "ids"))


@query
def q_kfold_stratified(data):
    rows = stage(data.train.select("id", combine.TARGET), "ids")
    return splits.kfold_stratified(rows, combine.TARGET)


# Metrics on repeatable scores


@query
def q_fold_mean(data):
    folds = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("fold")
    key = F.concat_ws(":", "id", "fold")
    scored = data.test.select("id", folds).withColumn("score", seeded_uniform(key, splits.SEED, "fold_score"))
    return aggregate.mean_by_key(scored, "id", "score")


@table_query
def q_roc_auc(spark, folder):
    data = from_star_schema(spark, folder)
    rows = data.train.select("id", F.col(combine.TARGET).alias("label")).withColumns(hash_scores("score_a"))
    documents = read_parquet(spark, f"{folder}/documents.parquet").select("doc_id", "n_chars")
    labels = read_parquet(spark, f"{folder}/labels.parquet").select("doc_id", "quality")
    graded = labels.join(documents, "doc_id")
    long = combine.union_all(
        [
            rows.select(F.lit("impressions").alias("dataset"), "label", F.col("score_a").alias("score")),
            graded.select(
                F.lit("documents").alias("dataset"),
                F.col("quality").alias("label"),
                F.col("n_chars").cast("double").alias("score"),
            ),
        ]
    )
    return metrics.roc_auc(long, "label", "score", ["dataset"])


@query
def q_confusion(data):
    scored = data.train.withColumns(hash_scores("score_a"))
    judged = scored.withColumn("prediction", numeric.hard_class(F.col("score_a")))
    return metrics.confusion_matrix(judged, combine.TARGET, "prediction")


# Files


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@table_query
def q_reject_counts(spark, folder):
    """Orders written as text with faults by rule, read with the checks: rejected values per column and reason."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    faulty_day = F.when(key % 7 == 0, "31/02/1996").when(key % 11 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    customer = F.when(key % 5 != 0, F.col("o_custkey").cast("string")).otherwise("")
    line = F.concat_ws(",", key.cast("string"), customer, F.coalesce(faulty_day, day), price)
    line = F.when(key % 17 == 0, F.concat_ws(",", key.cast("string"), customer)).otherwise(line)
    path = _own_folder(spark, "orders-text")
    read_parquet(spark, f"{folder}/orders.parquet").select(line.alias("value")).write.text(path)
    schema = StructType(
        [
            StructField("order_id", LongType(), False),
            StructField("customer_id", LongType(), False),
            StructField("day", DateType()),
            StructField("price", DoubleType()),
        ]
    )
    checked = rejects.read_checked(spark, path, schema, {"day": "dd/MM/yyyy"}, header=False)
    counts = rejects.reject_counts(checked.rejects).groupBy("column_name", "reason").agg(F.sum("n").alias("n"))
    good = checked.rows.agg(F.count("*").alias("n")).select(F.lit("(good)").alias("column_name"), F.lit("").alias("reason"), "n")
    found = stage(counts.unionByName(good), "reject-counts")
    remove_folder(spark, path)
    return found


@query
def q_submission_file(data):
    """A submission in the template's order: written to numbered files, read back, and its order checked."""
    spark = data.test.sparkSession
    path = _own_folder(spark, "submission")
    scores = data.test.select("id").withColumns(hash_scores("score_a"))
    order = ["coupon_id", "customer_id", "campaign_id"]
    modelling.write_ordered_submission(data.test, scores, "score_a", path, order)
    schema = StructType([StructField("id", LongType()), StructField(combine.TARGET, DoubleType())])
    back = ordered_files.read_ordered(spark, path, schema)
    place = F.struct(*[(F.floor(F.col("id") / low) % high).alias(c) for c, low, high in ID_PARTS])
    lines = Window.partitionBy("_file").orderBy("_block", "_line")
    checked = back.withColumn("in_order", F.coalesce(F.lag(place).over(lines) < place, F.lit(True)))
    found = stage(checked.select("id", combine.TARGET, "in_order"), "submission-rows")
    remove_folder(spark, path)
    return found


# Models


def _model_rows(spark: SparkSession, folder: str) -> ModelTable:
    return modelling.model_table(prepare.feature_table(from_star_schema(spark, folder)))


def model_query(fn: Callable[[ModelTable], DataFrame]) -> Callable[[ModelTable], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(_model_rows(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


@model_query
def q_gbt_scores_a(table):
    return boosting.add_score(boosting.fit(table.train, PARAMS_A), table.test).select("id", "score")


@model_query
def q_gbt_scores_b(table):
    return boosting.add_score(boosting.fit(table.train, PARAMS_B), table.test).select("id", "score")


@model_query
def q_holdout_auc(table):
    return modelling.holdout_report(table, PARAMS_A).auc


@model_query
def q_top_features(table):
    return modelling.top_features(boosting.fit(table.train, PARAMS_A), table)


@model_query
def q_cv_tree_count(table):
    return selection.cv_tree_count(table.train, PARAMS_A).table


def _held_out(table: ModelTable, params: TreeParams = QUERY_PARAMS_B, n_folds: int = QUERY_FOLDS) -> DataFrame:
    folded = selection.into_folds(table.train, n_folds)
    models = selection.fit_folds(folded, params, n_folds, every=1)
    return selection.held_out_scores(folded, models)


@model_query
def q_oof_scores(table):
    return _held_out(table, PARAMS_B, FOLDS).select("id", "fold", "score")


@model_query
def q_oof_rows(table):
    """Every train row is scored once, by a model that has not seen its fold."""
    inside = F.count_if(F.col("score").between(0.0, 1.0))
    return _held_out(table).groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), inside.alias("n_in_range")
    )


@model_query
def q_early_stop(table):
    """A fit that may have 1000 trees of 31 leaves and ends when four trees have brought nothing."""
    fit_on, judge_on = modelling.holdout(table.train)
    fit = rounds.fit_rounds(fit_on, PARAMS_B_LEAVES, judge_on, patience=4, every=2)
    return rounds.history_table(table.train.sparkSession, fit)


@model_query
def q_leaf_limit(table):
    """Trees grown best-first to 31 leaves at most, on paths of up to 12 splits."""
    fit = rounds.fit_rounds(table.train, replace(PARAMS_B_LEAVES, trees=2), every=2)
    rows = [(i, n <= PARAMS_B_LEAVES.leaves, n > 1) for i, n in enumerate(fit.forest.leaves())]
    return table.train.sparkSession.createDataFrame(rows, "tree int, within_limit boolean, grown boolean")


@model_query
def q_fold_auc(table):
    return modelling.fold_auc(_held_out(table, PARAMS_B, FOLDS))


@model_query
def q_score_corr(table):
    mixed = modelling.blended_scores(table, PARAMS_A, PARAMS_B, FOLDS, every=1)
    return modelling.score_correlation(mixed.scores)


@model_query
def q_grid_search(table):
    grid = {"step": [0.05, 0.1], "depth": [3, 4], "trees": [1, 2]}
    return selection.grid_search(table.train, QUERY_PARAMS_B, grid, n_folds=QUERY_FOLDS)


@model_query
def q_random_search(table):
    """Five points drawn from the grid of step, depth and share of predictors."""
    grid = {"step": [0.05, 0.1], "depth": [3, 4], "feature_share": [0.8, 0.9, 1.0], "trees": [2]}
    return selection.grid_search(table.train, QUERY_PARAMS_B, grid, draws=5, n_folds=QUERY_FOLDS)


@model_query
def q_holdout_classes(table):
    """Confusion matrix of a fitted model on the rows it has not seen, summed up by true class."""
    cells = modelling.holdout_report(table, QUERY_PARAMS_A).confusion
    return cells.groupBy("label").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n"))


@model_query
def q_train_holdout_auc(table):
    """AUC of a fitted model on the rows it was fitted on, beside that on the others."""
    return modelling.train_and_holdout_auc(table, PARAMS_A)


@model_query
def q_submission(table):
    mixed = modelling.blended_scores(table, QUERY_PARAMS_A, QUERY_PARAMS_B, QUERY_FOLDS, every=1)
    return modelling.submission(table.test, mixed.scores, "score")
