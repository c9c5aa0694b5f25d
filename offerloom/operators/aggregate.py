"""Per-key profiles: the most frequent value of columns, and exact means of money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.sources.tables import ROWS_PER_TASK, stage

# Amounts are added up as decimals: the sum is exact to 18 decimals and the same on every run, in
# whatever order the rows arrive. A total that does not fit stops the query.
EXACT = "decimal(38,18)"


def money_sums(column: str) -> dict[str, Column]:
    return {f"_sum_{column}": F.sum(F.col(column).cast(EXACT)), f"_cnt_{column}": F.count(column)}


def money_mean(column: str) -> Column:
    """The mean from the parts of :func:`money_sums`; no amount at all gives NULL."""
    return F.when(F.col(f"_cnt_{column}") > 0, F.col(f"_sum_{column}").cast("double") / F.col(f"_cnt_{column}"))


def mean_money_by_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    sums = {name: part for c in columns for name, part in money_sums(c).items()}
    grouped = df.groupBy(key).agg(*[part.alias(name) for name, part in sums.items()])
    return grouped.select(key, *[money_mean(c).alias(c) for c in columns])


def mode_by_key(df: DataFrame, key: str, column: str) -> DataFrame:
    """Most frequent value of one column per key; the smallest of tied values wins.

    Values are counted per (key, value) before the key alone is grouped, so no
    task ever holds all values of a key. NULL is no value; a key with nothing
    else keeps NULL.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col(column).isNotNull(), F.struct(-F.col("n"), F.col(column))))
    return counts.groupBy(key).agg(best.getField(column).alias(column))


def modes_by_key(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """:func:`mode_by_key` for several columns. Every column is profiled on its own, so a result row need not match any input row.

    The rows are staged and then dealt out by key, each once, in tasks of some ``ROWS_PER_TASK`` rows; values are
    counted where their key lies. Only keys with more rows than that, of which there are few, have their values
    counted in all tasks before the counts are brought together.
    """
    rows = stage(df.filter(F.col(key).isNotNull()).select(key, *columns), "mode-rows")
    return _modes_of_staged(rows, key, columns)


def _modes_of_staged(rows: DataFrame, key: str, columns: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    n = rows.count()
    busy = []
    if n > rows_per_task:
        counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
        busy = [r[key] for r in counts.where(F.col("_n") > rows_per_task).select(key).collect()]  # fewer than n / rows_per_task
    usual = rows.where(~F.col(key).isin(busy)) if busy else rows
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_task))
    found = _local_modes(usual, key, columns, tasks)
    if busy:
        found = found.unionByName(_counted_modes(rows.where(F.col(key).isin(busy)), key, columns))
    return found


def _best(present: Column, c: str) -> Column:
    """The most frequent value of a column, the smallest of tied ones."""
    return F.min(F.when(present & F.col(c).isNotNull(), F.struct(-F.col("_n"), F.col(c)))).getField(c).alias(c)


def _local_modes(rows: DataFrame, key: str, columns: Sequence[str], tasks: int) -> DataFrame:
    """One shuffle, of the rows: all that is counted stays in the task that has the key."""
    kinds = dict(rows.dtypes)

    def entry(i: int) -> Column:
        own = [(F.col(c) if c == columns[i] else F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        return F.struct(F.lit(i).alias("_i"), *own)

    long = rows.repartition(tasks, key).select(key, F.inline(F.array(*map(entry, range(len(columns))))))
    counts = long.groupBy(key, "_i", *columns).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(*[_best(F.col("_i") == i, c) for i, c in enumerate(columns)])


def _counted_modes(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """No task holds all values of a key: grouping sets (key, column) are counted before each of two shuffles."""
    flags = {c: f"_is_{c}" for c in columns}
    counts = rows.groupingSets([[key, c] for c in columns], key, *columns).agg(
        F.count("*").alias("_n"), *[(F.grouping(c) == 0).alias(flag) for c, flag in flags.items()]
    )
    return counts.groupBy(key).agg(*[_best(F.col(flag), c) for c, flag in flags.items()])


def profile_by_key(df: DataFrame, key: str, modes: Sequence[str], means: Sequence[str]) -> DataFrame:
    """One row per key with the mode of some columns and the mean of others.

    The rows are staged once. The two parts read different columns of them, so that nothing is read twice.
    """
    rows = stage(df.filter(F.col(key).isNotNull()).select(key, *modes, *means), "profile-rows")
    amounts = mean_money_by_key(rows, key, means)
    return _modes_of_staged(rows, key, modes).join(amounts, key)


def mean_by_key(df: DataFrame, key: str, column: str) -> DataFrame:
    """Plain mean per key, e.g. of the scores several models gave one row."""
    return df.groupBy(key).agg(F.avg(column).alias(column))
