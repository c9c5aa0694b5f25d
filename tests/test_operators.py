import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerloom.operators import aggregate, combine, encode, joins, metrics, ordered, profile, sets, splits


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


# Modes and means

MODE_ROWS = [(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, None), (3, "z"), (3, "z"), (3, "a"), (None, "q")]


def test_mode_ignores_null_and_takes_the_smallest_on_ties(frame):
    df = frame(MODE_ROWS, "k int, v string")
    expected = [(1, "a"), (2, None), (3, "z")]
    assert rows_of(aggregate.mode_by_key(df, "k", "v"), "k") == expected
    assert rows_of(aggregate.modes_by_key(df, "k", ["v"]), "k") == expected


def test_modes_of_columns_are_independent(frame):
    df = frame([(1, "a", 2), (1, "a", 3), (1, "b", 3)], "k int, x string, y int")
    assert rows_of(aggregate.modes_by_key(df, "k", ["x", "y"]), "k") == [(1, "a", 3)]


def test_mode_against_a_plain_count(frame):
    rng = random.Random(3)
    # One key holds a third of all rows.
    data = [(0 if rng.random() < 0.33 else rng.randrange(40), rng.randrange(12), rng.choice("abc")) for _ in range(5000)]
    got = as_dict(aggregate.modes_by_key(frame(data, "k int, x int, y string"), "k", ["x", "y"]), "k", "x")
    for key, mode in got.items():
        counts = Counter(x for k, x, _ in data if k == key)
        assert mode == min(counts, key=lambda v: (-counts[v], v))


def test_money_means_are_exact(frame):
    data = [(1, 0.1)] * 10 + [(2, -5.25), (2, None), (3, None), (4, 90000.1234), (4, -0.0001)]
    got = as_dict(aggregate.mean_money_by_key(frame(data, "k int, v double"), "k", ["v"]), "k", "v")
    assert got == {1: 0.1, 2: -5.25, 3: None, 4: 900001233 / 10000 / 2}


def test_profile_has_modes_and_means(frame):
    data = [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 6.0), (2, "c", 4.5)]
    got = aggregate.profile_by_key(frame(data, "k int, m string, v double"), "k", ["m"], ["v"])
    assert rows_of(got, "k") == [(1, "a", 3.0), (2, "c", 4.5)]


# Order-dependent work


def test_forward_fill(frame):
    df = frame([(1, None), (2, "x"), (3, None), (4, "y"), (5, None)], "k int, v string")
    assert [v for _, v in rows_of(ordered.forward_fill(df, "k", ["v"]), "k")] == [None, "x", "x", "y", "y"]


def test_forward_fill_equals_the_simple_window_across_many_ranges(spark):
    rng = random.Random(5)
    keys = rng.sample(range(10**6), 3000)
    data = [(k, rng.choice([None] * 40 + ["p", "q"]), rng.choice([None] * 400 + [1.5])) for k in keys]
    df = spark.createDataFrame(data, "k int, a string, b double").repartition(8)
    got = ordered.forward_fill(df, "k", ["a", "b"])
    simple = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("k", *[F.last(c, ignorenulls=True).over(simple).alias(c) for c in ("a", "b")])
    assert rows_of(got, "k") == rows_of(expected, "k")


@pytest.fixture
def many_ranges(spark):
    """Keep adaptive execution from merging the small ranges of a test into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_order_carries_over_range_borders(spark, many_ranges):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") == 3, "only").alias("v"))
    ranged = ordered.into_ranges(df, ["k"])
    assert ranged.select(ordered.RANGE).distinct().count() > 4
    filled = ordered.forward_fill(df, "k", ["v"])
    assert filled.filter(F.col("v").isNull()).count() == 3
    assert filled.filter("v = 'only'").count() == 1997


def test_running_totals_in_groups(spark, many_ranges):
    rng = random.Random(7)
    data = [("big" if i % 3 else f"g{i % 7}", i, rng.randrange(10)) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, k int, n int").repartition(6)
    got = {(r.g, r.k): (r.n_before, r.n_total) for r in ordered.running_totals(df, "k", ["n"], ["g"]).collect()}
    assert len(got) == len(data)
    sums = Counter()
    for g, k, n in sorted(data):
        assert got[g, k][0] == sums[g]
        sums[g] += n
    assert all(total == sums[g] for (g, _), (_, total) in got.items())


def test_quantiles_are_those_of_numpy(spark, many_ranges):
    rng = np.random.default_rng(11)
    values = np.round(rng.exponential(50, 999), 2)
    # A third of all rows share one value.
    values[::3] = 12.5
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i int").repartition(5)
    wanted = {"lo": 0.0, "a": 0.1, "b": 0.37, "mid": 0.5, "c": 0.9, "hi": 1.0}
    got = ordered.quantiles(df, ["v", "i"], wanted)
    row = {r.column_name: r for r in got.collect()}
    for name, p in wanted.items():
        assert row["v"][name] == np.quantile(values, p)
        assert row["i"][name] == pytest.approx(np.quantile(np.arange(999), p))


def test_quantiles_of_one_value_and_of_nothing(frame):
    got = ordered.quantiles(frame([(1, 7.0, None)], "k int, one double, none double"), ["one", "none"], {"q": 0.5})
    assert rows_of(got, "column_name") == [("one", 7.0)]


# Profiling


def test_counts_leave_out_null(frame):
    df = frame([("a",), ("a",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in profile.category_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    assert rows_of(profile.value_shares(df, "v"), "v") == [("a", 2, 2 / 3), ("b", 1, 1 / 3)]
    assert rows_of(profile.unique_counts(df, ["v"]), "column_name") == [("v", 2)]
    assert rows_of(profile.table_info(df), "column_name") == [("v", "string", 1, 3)]


def test_approximate_unique_count_is_close(spark):
    got = profile.approx_unique_counts(spark.range(20000), ["id"]).first().n_unique
    assert abs(got - 20000) < 600


def test_describe_matches_the_statistics_module(frame):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, None]
    got = profile.describe(frame([(v,) for v in values], "v double"), ["v"]).first()
    known = [v for v in values if v is not None]
    assert (got.n, got.min, got.q25, got.q50, got.q75, got.max) == (5, 1.0, 1.0, 3.0, 4.0, 5.0)
    assert got["mean"] == pytest.approx(statistics.mean(known))
    assert got["std"] == pytest.approx(statistics.stdev(known))


def test_skewness_is_that_of_a_sample(frame):
    df = frame([(float(v),) for v in (1, 2, 3, 10, 50)], "v double")
    assert profile.skewness_table(df, {"v": F.col("v")}).first().skewness == pytest.approx(2.0855561345)
    two = frame([(1.0,), (2.0,)], "v double")
    assert profile.skewness_table(two, {"v": F.col("v")}).first().skewness is None


def test_correlations(frame):
    df = frame([(1, 2.0, -1.0), (2, 4.0, -2.0), (3, 6.0, -3.5)], "a int, b double, c double")
    got = {(r.column_a, r.column_b): r["corr"] for r in profile.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "b"] == pytest.approx(1.0)
    assert got["a", "c"] == got["c", "a"] == pytest.approx(np.corrcoef([1, 2, 3], [-1, -2, -3.5])[0, 1])


@pytest.mark.parametrize("bins", [1, 4, 10, 50])
def test_histogram_is_that_of_numpy(frame, bins):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 2.5, 2.5]
    got = profile.histogram(frame([(v,) for v in values], "v double"), F.col("v"), bins)
    counts, edges = np.histogram(values, bins)
    assert [n for _, _, n in rows_of(got, "bin")] == counts.tolist()
    assert [e for _, e, _ in rows_of(got, "bin")] == pytest.approx(edges[:-1].tolist())


def test_histograms_of_several_values_and_one_without_rows(frame):
    rows = frame([(1.0, 5, None), (2.0, None, None), (9.0, 5, None)], "a double, b int, c double")
    got = profile.histograms(rows, {"a": (F.col("a"), 2), "b": (F.col("b") * 2, 3), "c": (F.col("c"), 4)})
    counts = {}
    for r in got.orderBy("column_name", "bin").collect():
        counts.setdefault(r.column_name, []).append(r.n)
    assert counts == {"a": [2, 1], "b": [0, 2, 0]}


def test_profile_without_amounts_or_key(frame):
    rows = [(1, "x", 1, 0.1), (1, "x", 2, 0.2), (1, "y", 2, None), (2, None, None, None), (None, "z", 1, 5.0)]
    got = aggregate.profile_by_key(frame(rows, "k int, m string, q int, v double"), "k", ["m", "q"], ["v"])
    assert sorted(map(tuple, got.collect())) == [(1, "x", 2, 0.15), (2, None, None, None)]


def test_histogram_of_a_single_value_and_of_nothing(frame):
    got = profile.histogram(frame([(5.0,), (5.0,), (None,)], "v double"), F.col("v"), 4)
    assert [n for _, _, n in rows_of(got, "bin")] == np.histogram([5.0, 5.0], 4)[0].tolist()
    assert profile.histogram(frame([(None,)], "v double"), F.col("v"), 4).isEmpty()


# Combining, sets, joins


def test_union_keeps_rows_and_leaves_the_label_null(frame):
    train = frame([(1, 0), (2, 1)], "id int, redemption_status int")
    test = frame([(3,)], "id int")
    both = combine.union_tagged({"train": train, "test": test})
    assert rows_of(both, "id") == [(1, 0, "train"), (2, 1, "train"), (3, None, "test")]
    split = combine.split_by_source(both)
    assert split.train.columns == ["id", "redemption_status"] and split.train.count() == 2
    assert split.test.columns == ["id"] and split.target == "redemption_status"
    assert split.id_columns[0] == "id"


def test_column_selection(frame):
    df = frame([(1, "a", 2.0)], "id int, name string, v double")
    assert combine.string_columns(df) == ["name"]
    assert combine.columns_except(df, ["v"]) == ["id", "name"]


def test_top_rows_break_ties(frame):
    df = frame([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "k string, n int")
    assert [r.k for r in combine.top_rows(df, ["n"], 3, ["k"]).collect()] == ["b", "c", "d"]


def test_key_sets(frame):
    left, right = frame([(1,), (1,), (2,), (3,)], "k int"), frame([(3,), (3,), (4,)], "k int")
    assert rows_of(sets.keys_only_in(left, right, "k"), "k") == [(1,), (2,)]
    assert rows_of(sets.keys_in_both(left, right, "k"), "k") == [(3,)]
    assert sets.overlap_size(left, right, "k").first().n_common == 1
    assert [r.k for r in sets.sorted_distinct(left, "k").collect()] == [1, 2, 3]


def test_lookup_keeps_every_row_and_refuses_clashing_names(frame):
    rows = frame([(1, 10), (2, 20), (3, None)], "id int, k int")
    table = frame([(10, 5)], "k int, id int")
    with pytest.raises(ValueError, match="id"):
        joins.lookup(rows, table, "k")
    joined = joins.lookup(rows, table, "k", {"id": "other"})
    assert rows_of(joined.select("id", "other"), "id") == [(1, 5), (2, None), (3, None)]


def test_hot_key_is_split_when_the_lookup_is_too_large_to_broadcast(spark):
    """Half of all rows carry one key; adaptive execution cuts that partition into several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 200000, 1, 8).select(
            "id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).alias("k")
        )
        table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = joins.lookup(rows, table, "k")
        assert len(joined.collect()) == 200000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert joined.filter("v is null or v <> k * 2").isEmpty()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# Encoders


def test_codes_follow_the_typed_order(frame):
    df = frame([(v,) for v in (10, 2, 1, 12, 3, None)], "income int")
    got = as_dict(encode.label_encode(df, {"income": "code"}), "income", "code")
    assert got == {1: 0, 2: 1, 3: 2, 10: 3, 12: 4, None: None}


def test_long_level_lists_are_coded_by_lookup_with_the_same_result(frame, monkeypatch):
    df = frame([(f"v{i % 60:03d}", i % 5) for i in range(300)] + [(None, None)], "a string, b int")
    codes = {"a": "a_code", "b": "b_code"}
    short = encode.label_encode(df, codes)
    monkeypatch.setattr(encode, "MAX_INLINE_LEVELS", 20)
    found = encode.fit_levels(df, ["a", "b"])
    assert found["a"] is None and found["b"] == [0, 1, 2, 3, 4]
    long = encode.label_encode(df, codes)
    columns = ["a", "b", "a_code", "b_code"]
    assert rows_of(long.select(columns), *columns) == rows_of(short.select(columns), *columns)
    with pytest.raises(ValueError, match="levels"):
        encode.short_levels(found, "a")


def test_dummies(frame):
    df = frame([(0,), (1,), (2,), (None,)], "v int")
    dropped = encode.dummies("v", [0, 1, 2], prefix="v", drop_first=True)
    assert list(dropped) == ["v_1", "v_2"]
    assert rows_of(df.withColumns(dropped), "v") == [(None, 0, 0), (0, 0, 0), (1, 1, 0), (2, 0, 1)]
    named = encode.dummies("t", ["X", "Y"], names={"X": "type_x"})
    assert list(named) == ["type_x", "Y"]


def test_category_bins(frame):
    df = frame([(3,), (7,), (4,), (None,)], "c int")
    got = as_dict(df.withColumn("b", encode.category_bins(F.col("c"), [3, 7])), "c", "b")
    assert got == {3: "3", 7: "7", 4: "other", None: None}


# Splits


def test_hash_splits(spark):
    ids = spark.range(20000)
    held = splits.holdout_split(ids).filter("split = 'val'").count()
    assert 4700 < held < 5300
    sizes = as_dict(splits.kfold(ids).groupBy("fold").count(), "fold", "count")
    assert set(sizes) == set(range(10)) and all(1800 < n < 2200 for n in sizes.values())
    # Hold-out and folds are drawn apart: every fold loses about a quarter.
    both = splits.kfold(splits.holdout_split(ids)).filter("split = 'val'").groupBy("fold").count()
    assert all(400 < r["count"] < 600 for r in both.collect())


@pytest.mark.parametrize("n", [7, 1003, 5000])
def test_exact_folds_differ_by_one_row_at_most(spark, n):
    folds = as_dict(splits.kfold_exact(spark.range(n)).groupBy("fold").count(), "fold", "count")
    sizes = [folds.get(i, 0) for i in range(10)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_stratified_folds_share_each_label(spark):
    rows = spark.range(4000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    got = splits.kfold_stratified(rows, "y").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in got if r.y == 1} == {8}
    assert {r["count"] for r in got if r.y == 0} == {392}


def test_fold_rows(spark):
    fit_on, score_on = splits.fold_rows(splits.kfold(spark.range(100)), 3)
    assert fit_on.count() + score_on.count() == 100
    assert score_on.filter("fold <> 3").isEmpty()


# Metrics


def test_auc_of_the_textbook_case(frame):
    df = frame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == 0.75


def test_auc_with_ties_and_groups_against_all_pairs(spark, many_ranges):
    rng = random.Random(13)
    data = [(g, int(rng.random() < 0.3), rng.randrange(8) / 8) for g in "ab" for _ in range(200)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(data, "g string, y int, s double").repartition(4)
    got = as_dict(metrics.roc_auc(df, "y", "s", ["g"]), "g", "auc")
    assert got["one"] is None
    for g in "ab":
        pos = [s for k, y, s in data if k == g and y == 1]
        neg = [s for k, y, s in data if k == g and y == 0]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[g] == pytest.approx(wins / len(pos) / len(neg))


def test_confusion_has_all_cells(frame):
    df = frame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    assert rows_of(metrics.confusion_matrix(df, "y", "p"), "label", "prediction") == [
        (0, 0, 1),
        (0, 1, 1),
        (1, 0, 0),
        (1, 1, 2),
    ]


def test_means_keep_every_decimal(frame):
    rows = as_dict(aggregate.mean_money_by_key(frame([(1, 0.00004), (1, 0.00002)], "k int, v double"), "k", ["v"]), "k", "v")
    assert rows[1] == pytest.approx(0.00003, rel=1e-12)


def test_null_group_has_its_auc(frame):
    data = [(None, 0, 0.1), (None, 1, 0.9), (1, 0, 0.9), (1, 1, 0.1)]
    rows = as_dict(metrics.roc_auc(frame(data, "g int, y int, s double"), "y", "s", ["g"]), "g", "auc")
    assert rows == {None: 1.0, 1: 0.0}


@pytest.mark.parametrize("label, prediction", [(None, 1), (2, 1), (1, None), (0, 3)])
def test_unknown_class_stops_the_confusion_matrix(frame, label, prediction):
    with pytest.raises(Exception, match="have to be 0 or 1"):
        metrics.confusion_matrix(frame([(label, prediction), (1, 1)], "y int, p int"), "y", "p").collect()


def test_missing_predictor_is_an_error(frame):
    from offerloom.plans.modelling import predictors

    with pytest.raises(ValueError, match="campaign_id"):
        predictors(frame([(1,)], "coupon_id int"))


def test_wrong_date_stops_the_query(frame):
    from offerloom.functions.dates import parse_date_or_fail

    good = frame([("21/10/13",), (None,), (" ",)], "t string").select(parse_date_or_fail(F.col("t"), "dd/MM/yy").alias("d"))
    assert sorted(str(r["d"]) for r in good.collect()) == ["2013-10-21", "None", "None"]
    with pytest.raises(Exception, match="no date in the format"):
        frame([("2013-10-21",)], "t string").select(parse_date_or_fail(F.col("t"), "dd/MM/yy")).collect()
