"""Stacking, splitting and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = "redemption_status"
ID_COLUMNS = ["id", "campaign_id", "coupon_id", "customer_id"]


class SourceSplit(NamedTuple):
    train: DataFrame
    test: DataFrame
    target: str
    id_columns: list[str]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column one of them lacks becomes NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Stack frames and record in ``source`` which one each row came from."""
    return union_all(df.withColumn("source", F.lit(tag)) for tag, df in frames.items())


def split_by_source(df: DataFrame) -> SourceSplit:
    """Undo :func:`union_tagged`; the target has no meaning on test rows and is dropped there."""
    train = df.filter(F.col("source") == "train").drop("source")
    test = df.filter(F.col("source") == "test").drop("source", TARGET)
    return SourceSplit(train, test, TARGET, list(ID_COLUMNS))


def columns_except(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in set(excluded)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def top_rows(df: DataFrame, by: Sequence[str], n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The n largest rows; ``tie_break`` columns make the choice unique."""
    order = [F.desc(c) for c in by] + [F.asc(c) for c in tie_break]
    return df.orderBy(*order).limit(n)
