import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from offerloom.functions import dates, levels, numeric
from offerloom.functions.hashing import seeded_hash


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_dates_with_stated_format(spark):
    texts = spark.createDataFrame([(0, "21/10/13"), (1, "10/12/13"), (2, "bad"), (3, None)], "i int, t string")
    parsed = texts.orderBy("i").select(dates.parse_date(F.col("t"), "dd/MM/yy").alias("d"))
    assert values(parsed, "d") == [dt.date(2013, 10, 21), dt.date(2013, 12, 10), None, None]


def test_two_digit_years_follow_the_pivot(spark):
    texts = spark.createDataFrame([(0, "10/01/95"), (1, "29/02/96"), (2, "10/01/69"), (3, "01/01/70")], "i int, t string")
    parsed = texts.orderBy("i").select(dates.parse_date(F.col("t"), "dd/MM/yy").alias("d"))
    assert values(parsed, "d") == [
        dt.date(1995, 1, 10),
        dt.date(1996, 2, 29),
        dt.date(2069, 1, 10),
        dt.date(1970, 1, 1),
    ]


def test_month_first_falls_back_to_day_first(spark):
    texts = spark.createDataFrame([(0, "21/10/13"), (1, "10/12/13")], "i int, t string").orderBy("i")
    parsed = texts.select(dates.parse_date_month_first(F.col("t"), "MM/dd/yy", "dd/MM/yy").alias("d"))
    assert values(parsed, "d") == [dt.date(2013, 10, 21), dt.date(2013, 10, 12)]


def test_durations_have_no_sign_and_the_audit_sees_it(spark):
    row = spark.createDataFrame([(dt.date(2013, 10, 21), dt.date(2013, 10, 9))], "s date, e date")
    s, e = F.col("s"), F.col("e")
    got = row.select(dates.duration_days(s, e), dates.ends_before_start(s, e), dates.signed_days(s, e)).first()
    assert tuple(got) == (12, True, -12)


def test_date_parts(spark):
    row = spark.createDataFrame([(dt.date(2013, 10, 21),)], "start_date date")
    assert row.select(*[v.alias(k) for k, v in dates.date_parts("start_date").items()]).first().asDict() == {
        "start_year": 2013,
        "start_month": 10,
    }


def test_logs(spark):
    row = spark.createDataFrame([(-3.0, 0.0, None)], "d double, p double, n double")
    d, p, n = row.select(
        numeric.log_discount(F.col("d")), numeric.log_price(F.col("p")), numeric.log_price(F.col("n"))
    ).first()
    assert d == pytest.approx(math.log(10)) and p == 0.0 and n is None


def test_blend_and_threshold(spark):
    row = spark.createDataFrame([(0.2, 0.6, 0.5, None)], "a double, b double, half double, n double")
    got = row.select(
        numeric.blend([F.col("a"), F.col("b")], [0.5, 0.5]),
        numeric.hard_class(F.col("b")),
        numeric.hard_class(F.col("half")),
        numeric.hard_class(F.col("n")),
    ).first()
    assert got[0] == pytest.approx(0.4) and tuple(got[1:]) == (1, 0, None)
    with pytest.raises(ValueError):
        numeric.blend([F.col("a")], [0.5, 0.5])


def test_demographics_are_imputed(spark):
    rows = [(1, None, None, "5+"), (2, "3+", "Single", "2")]
    people = spark.createDataFrame(rows, "customer_id int, no_of_children string, marital_status string, family_size string")
    got = people.withColumns(levels.impute_demographics()).orderBy("customer_id").collect()
    assert [tuple(r) for r in got] == [(1, "0", "Unknown", "5"), (2, "3", "Single", "2")]


def test_hash_depends_on_seed_purpose_and_key_only(spark):
    keys = spark.range(1000)
    got = keys.select(
        seeded_hash(F.col("id"), 26, "a").alias("a"),
        seeded_hash(F.col("id"), 26, "a").alias("same"),
        seeded_hash(F.col("id"), 26, "b").alias("b"),
    )
    assert got.filter("a <> same").isEmpty()
    assert got.filter("a = b").count() < 5
    low, high = got.agg(F.min("a"), F.max("a")).first()
    assert 0 <= low < high < 2**32
