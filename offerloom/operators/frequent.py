"""The most frequent values without shuffling all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def _count_in(values: DataFrame, column: str, buckets: list[int], k: int) -> list[tuple]:
    """The k most frequent (value, n) of the values that fall into some buckets."""
    wanted = values.sparkSession.createDataFrame([(b,) for b in buckets], "_bucket int")
    inside = values.join(F.broadcast(wanted), "_bucket", "left_semi")  # bucket numbers, BUCKETS at most
    counts = inside.groupBy(column).agg(F.count("*").alias("n"))
    return [tuple(r) for r in counts.orderBy(F.desc("n"), column).limit(k).collect()]


def top_values(df: DataFrame, column: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k most frequent values with exact counts, equal counts by value; NULL is no value.

    Rows are first counted per hash bucket of their value: one row per bucket and task is shuffled. No value is more
    frequent than its bucket. The values of the fullest buckets are then counted; the k-th count among them is a
    floor, and buckets below it hold nothing that belongs in the answer. The others, if any, are counted in a
    third pass, so the answer is exact. Only where frequencies are nearly equal do most buckets stay above the
    floor, and then their values are shuffled as in a plain count.
    """
    spark = df.sparkSession
    if k < 1:
        raise ValueError("k has to be 1 or more")
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    values = df.where(F.col(column).isNotNull()).select(column).withColumn("_bucket", bucket)
    sizes = values.groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
    sizes = sorted(((r["n"], r["_bucket"]) for r in sizes), reverse=True)
    first = max(64, 4 * k)
    found = _count_in(values, column, [b for _, b in sizes[:first]], k) if sizes else []
    floor = found[k - 1][1] if len(found) == k else 0
    rest = [b for n, b in sizes[first:] if n >= floor]
    if rest:
        found += _count_in(values, column, rest, k)
    schema = values.select(column, F.lit(0).cast("bigint").alias("n")).schema
    # k rows of each pass
    return spark.createDataFrame(found, schema).orderBy(F.desc("n"), column).limit(k)
