"""Categorical encoders: codes, dummies and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.joins import lookup
from offerloom.operators.ordered import running_totals

# Level lists up to this length live in the plan; longer ones become a lookup table.
MAX_INLINE_LEVELS = 1000

# Sorted levels per column; None where there are too many to list.
Levels = Mapping[str, list[Any] | None]


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[Any] | None]:
    """The sorted different values of each column, all found in one pass.

    Values keep their type, so numbers sort as numbers. If the columns together
    have more than ``MAX_INLINE_LEVELS`` values, those still unknown are None and
    the caller uses :func:`code_table`, which has no limit.
    """
    columns = list(columns)
    found = (
        df.select(*columns)
        .groupingSets([[c] for c in columns], *columns)
        .agg(*[(F.grouping(c) == 0).alias(f"_is_{c}") for c in columns])
    )
    rows = found.limit(MAX_INLINE_LEVELS + 1).collect()
    if len(rows) <= MAX_INLINE_LEVELS:
        return {c: sorted(r[c] for r in rows if r[f"_is_{c}"] and r[c] is not None) for c in columns}
    if len(columns) == 1:
        return {columns[0]: None}
    # One long column must not hide the short ones.
    return {c: fit_levels(df, [c])[c] for c in columns}


def short_levels(levels: Levels, column: str) -> list[Any]:
    """Levels of a column that is to become one output column per level."""
    found = levels[column]
    if found is None:
        raise ValueError(f"{column} has more than {MAX_INLINE_LEVELS} levels, too many for dummy columns")
    return found


def code_of(value: Column, levels: Sequence[Any]) -> Column:
    """Position of a value among its sorted levels; NULL stays NULL."""
    if not levels:
        return F.lit(None).cast("int")
    known = F.array(*[F.lit(v) for v in levels])
    return (F.nullif(F.array_position(known, value), F.lit(0)) - 1).cast("int")


def code_table(df: DataFrame, column: str, code: str) -> DataFrame:
    """(value, code) for any number of levels, ranked without one task seeing them all."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(values, column, ["_one"])
    return ranked.select(column, F.col("_one_before").cast("int").alias(code))


def label_encode(df: DataFrame, codes: Mapping[str, str], levels: Levels | None = None) -> DataFrame:
    """Add a code column for each {column: code column}.

    Few levels: an expression, no join and no shuffle. Many: a lookup join.
    """
    levels = levels or fit_levels(df, list(codes))
    inline = {code: code_of(F.col(c), levels[c]) for c, code in codes.items() if levels[c] is not None}
    out = df.withColumns(inline)
    for column, code in codes.items():
        if levels[column] is None:
            out = lookup(out, code_table(df, column, code), column)
    return out


def dummies(
    column: str,
    levels: Sequence[Any],
    prefix: str | None = None,
    drop_first: bool = False,
    names: Mapping[Any, str] | None = None,
) -> dict[str, Column]:
    """0/1 columns, one per level in sorted order; NULL gives 0 in all of them.

    ``drop_first`` leaves out the lowest level. Without a prefix a column is called
    like its level, unless ``names`` has another name for it.
    """
    kept = list(levels)[1:] if drop_first else list(levels)

    def name(level: Any) -> str:
        if names and level in names:
            return names[level]
        return f"{prefix}_{level}" if prefix else str(level)

    value = F.col(column)
    return {name(v): F.coalesce((value == F.lit(v)).cast("int"), F.lit(0)) for v in kept}


def category_bins(value: Column, kept: Sequence[int], other: str = "other") -> Column:
    """Keep some codes as they are and put all others into one bin."""
    return F.when(value.isin(*kept), value.cast("string")).when(value.isNotNull(), other)
