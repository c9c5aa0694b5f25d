"""Bracketed quantiles and most frequent values against plain computations."""

import math
import random
from collections import Counter

import pytest

from offerloom.operators import frequent, ordered, profile

SHARES = {"p0": 0.0, "p1": 0.001, "p25": 0.25, "p50": 0.5, "p77": 0.77, "p999": 0.999, "p100": 1.0}


def plain_quantile(values, p):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    place = (len(values) - 1) * p
    low, high, part = values[math.floor(place)], values[math.ceil(place)], place - math.floor(place)
    if part == 0 or low == high:
        return low
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


@pytest.fixture(scope="module")
def numbers(spark):
    drawn = random.Random(5)
    rows = [
        (
            drawn.choice([0.0, -0.0, 1.0, 2.5, drawn.gauss(0, 1)]),
            drawn.randint(0, 5),
            drawn.choice([None, math.inf, -math.inf, drawn.random()]),
            drawn.choice([math.nan, drawn.random(), drawn.random()]),
            None,
        )
        for _ in range(6000)
    ]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, none double").repartition(4).cache()
    return df, {c: [float(r[i]) for r in rows if r[i] is not None] for i, c in enumerate("abcd")}


@pytest.mark.parametrize("bracket, error", [(1 << 16, ordered.RANK_ERROR), (3, ordered.RANK_ERROR), (1 << 16, 1e-7)])
def test_quantiles_are_exact(numbers, monkeypatch, bracket, error):
    # a bracket of 3 values makes the sketch narrow it again; with too small an error brackets miss and are begun anew
    monkeypatch.setattr(ordered, "BRACKET", bracket)
    monkeypatch.setattr(ordered, "RANK_ERROR", error)
    df, values = numbers
    got = {r.column_name: r for r in ordered.quantiles(df, [*values, "none"], SHARES).collect()}
    assert set(got) == set(values)
    for c in values:
        for name, p in SHARES.items():
            want = plain_quantile(values[c], p)
            assert got[c][name] == want or math.isnan(want) and math.isnan(got[c][name])


def test_describe_of_columns_without_values(numbers):
    df, values = numbers
    got = {r.column_name: r for r in profile.describe(df, ["b", "none"]).collect()}
    assert got["b"].n == 6000 and got["b"].q50 == plain_quantile(values["b"], 0.5) and got["b"].max == 5.0
    assert got["none"].n == 0 and got["none"].mean is None and got["none"].q25 is None
    empty = profile.describe(df.limit(0), ["a", "b"]).collect()
    assert [(r.n, r.min, r.q50) for r in empty] == [(0, None, None)] * 2


def top(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:k]


@pytest.mark.parametrize("buckets", [1 << 16, 70, 3])
def test_top_values_equal_full_counts(spark, buckets):
    drawn = random.Random(2)
    skewed = [f"v{int(drawn.paretovariate(0.7))}" for _ in range(4000)] + [None] * 50
    flat = [str(i % 500) for i in range(2000)]  # all equally frequent: the value decides
    for values in (skewed, flat, ["x"], []):
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
        got = [tuple(r) for r in frequent.top_values(df, "v", 7, buckets).collect()]
        assert got == top(values, 7)


def test_the_fullest_bucket_need_not_hold_a_frequent_value(spark):
    """Many rare values in one bucket outweigh a frequent value that has a bucket of its own."""
    buckets = 512
    hashed = spark.range(200_000).selectExpr("id", f"pmod(xxhash64(id), {buckets}) as bucket")
    rare = hashed.where("bucket < 64").limit(16_000)  # some 250 values in each of 64 buckets, once each
    one = hashed.where("bucket = 100").limit(1)
    often = one.selectExpr("explode(array_repeat(id, 40)) as id")
    df = rare.select("id").unionByName(often).repartition(3).cache()
    # the first 64 buckets to be counted are those of the rare values, and none of them is in the answer
    assert [tuple(r) for r in frequent.top_values(df, "id", 1, buckets).collect()] == [(one.first().id, 40)]
