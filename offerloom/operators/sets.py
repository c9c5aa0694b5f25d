"""Key sets. Each side is made distinct before the shuffle, so repeated keys cost nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def keys_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().subtract(right.select(key).distinct())


def keys_in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().intersect(right.select(key).distinct())


def overlap_size(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return keys_in_both(left, right, key).agg(F.count("*").alias("n_common"))
