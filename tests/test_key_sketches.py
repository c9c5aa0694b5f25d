"""Stored sketches of key sets against exact sets."""

import shutil

import pytest

from offerloom.operators import key_sketches


def keys(spark, low, high, extra=()):
    df = spark.range(low, high).selectExpr("id as k", "cast(id % 50 as string) as s")
    return df.unionByName(df.limit(20)).unionByName(spark.createDataFrame([(None, None), *extra], "k bigint, s string"))


def test_small_sets_are_exact_and_parts_add_up(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    key_sketches.store_part(keys(spark, 0, 600), ["k", "s"], left, "a")
    key_sketches.store_part(keys(spark, 500, 1000), ["k", "s"], right, "a")
    got = {r.column_name: r for r in key_sketches.set_sizes(spark, left, right).collect()}
    assert tuple(got["k"])[1:] == (600, 500, 1000, 100, 500, 400, 0.0)
    assert tuple(got["s"])[1:] == (50, 50, 50, 50, 0, 0, 0.0)
    # another part: only its rows are read, and nothing of the first part is written
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "l" / "part=a").iterdir())
    key_sketches.store_part(keys(spark, 900, 2000), ["k", "s"], left, "b")
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "l" / "part=a").iterdir()) == before
    both = {r.column_name: r for r in key_sketches.set_sizes(spark, left, right).collect()}["k"]
    assert tuple(both)[1:] == (1700, 500, 2000, 200, 1500, 300, 0.0)
    key_sketches.store_part(keys(spark, 900, 2000), ["k", "s"], left, "b")  # loaded again
    assert {r.column_name: r for r in key_sketches.set_sizes(spark, left, right).collect()}["k"] == both


def test_large_sets_are_within_the_bound(spark, tmp_path):
    left, right = str(tmp_path / "l"), str(tmp_path / "r")
    key_sketches.store_part(spark.range(0, 700_000).selectExpr("id as k"), ["k"], left, "a")
    key_sketches.store_part(spark.range(400_000, 1_000_000).selectExpr("id as k"), ["k"], right, "a")
    r = key_sketches.set_sizes(spark, left, right).first()
    want = dict(n_left=700_000, n_right=600_000, n_union=1_000_000, n_both=300_000, n_only_left=400_000, n_only_right=300_000)
    assert 0 < r.error_bound < 0.02 * 1_000_000
    for name, n in want.items():
        assert abs(r[name] - n) <= r.error_bound
    with pytest.raises(Exception):
        key_sketches.set_sizes(spark, left, str(tmp_path / "none")).collect()
    shutil.rmtree(right)
