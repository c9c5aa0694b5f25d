"""Table profiling. Every report is one pass with partial aggregation, in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.ordered import as_doubles, bracketed_quantiles, quantile_brackets
from offerloom.sources.tables import discard, stage


def _tagged(tables: Mapping[str, DataFrame], report) -> DataFrame:
    parts = [report(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    def report(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))

    return _tagged(tables, report)


def table_info(df: DataFrame) -> DataFrame:
    """Type, NULL count and value count of every column."""
    nulls = {f.name: F.count(F.when(F.col(f.name).isNull(), 1)) for f in df.schema.fields}
    counted = df.agg(F.count("*").alias("_rows"), *[n.alias(c) for c, n in nulls.items()])
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    long = counted.unpivot("_rows", df.columns, "column_name", "n_null")
    return long.select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "n_null",
        (F.col("_rows") - F.col("n_null")).alias("n_non_null"),
    )


def table_infos(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _tagged(tables, table_info)


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of different values per column; NULL is not counted."""
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "n_unique")


def approx_unique_counts(df: DataFrame, columns: Sequence[str], rsd: float = 0.01) -> DataFrame:
    """The same from sketches of fixed size, for when an estimate is enough."""
    counted = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "n_unique")


def unique_count_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    parts = [
        unique_counts(df, columns).select(F.lit(name).alias("table_name"), "*")
        for name, (df, columns) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULL is no value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several columns in one pass, values as text."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "level"
    )
    return long.filter(F.col("level").isNotNull()).groupBy("column_name", "level").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value in the order of the values, as a bar chart needs them."""
    return value_counts(df, column).orderBy(column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of rows per value. The total is one number, added up from the counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def positive_rate(df: DataFrame, column: str) -> DataFrame:
    """Mean of a 0/1 column in per cent, from whole numbers."""
    return df.agg((F.sum(column) * F.lit(100.0) / F.count(column)).alias("positive_rate_pct"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    numeric = stage(as_doubles(df, columns), "numbers")  # each round of the quantiles reads them again
    moments = [f(c).alias(f"{c}|{name}") for c in columns for name, f in measures.items()]
    first = quantile_brackets(numeric, columns, quartiles, moments)
    found = {r[0]: r[1:] for r in bracketed_quantiles(numeric, first, columns, quartiles)}
    discard(numeric)
    rows = []
    for c in columns:
        n, mean, std, low, high = (first[f"{c}|{name}"] for name in measures)
        rows.append((c, n, mean, std, low, *found[c], high))
    names = ["mean", "std", "min", *quartiles, "max"]
    # one row per column
    return df.sparkSession.createDataFrame(rows, "column_name string, n bigint, " + ", ".join(f"{n} double" for n in names))


def skewness(value: Column) -> Column:
    """Sample-adjusted skewness: Spark's own is that of the population."""
    n = F.count(value)
    adjusted = F.skewness(value) * F.sqrt(n * (n - F.lit(1))) / F.nullif(n - 2, F.lit(0))
    return F.when(n > 2, adjusted)


def skewness_table(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    wide = df.agg(*[skewness(value).alias(name) for name, value in values.items()])
    return wide.unpivot([], list(values), "column_name", "skewness")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, as a long matrix."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    wide = numeric.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{x}|{y}`").alias("corr"))
            for x, y in pairs
            for a, b in ([(x, y)] if x == y else [(x, y), (y, x)])
        ]
    )
    return wide.select(F.inline(cells))


def histograms(df: DataFrame, values: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Rows per equal-width bin of several values, each with its number of bins: column_name, bin, bin_from, n.

    One pass finds the spans of all values, one counts all bins. The last bin takes in its upper bound,
    empty bins show 0, and a value without any row has no bins.
    """
    numbers = df.select(*[value.cast("double").alias(name) for name, (value, _) in values.items()])
    ends = numbers.agg(*[f(name).alias(f"{name}|{end}") for name in values for end, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = {}
    for name, (_, bins) in values.items():
        lo, hi = ends[f"{name}|lo"], ends[f"{name}|hi"]
        if lo is not None:
            lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)  # a single value gets a span of one around it
            spans[name] = (lo, (hi - lo) / bins, bins)
    schema = "column_name string, bin int, bin_from double"
    # one row per bin
    edges = df.sparkSession.createDataFrame([(name, i, lo + step * i) for name, (lo, step, n) in spans.items() for i in range(n)], schema)
    if not spans:
        return edges.withColumn("n", F.lit(0).cast("bigint"))

    def place(name: str, lo: float, step: float, bins: int) -> Column:
        inside = F.least(F.floor((F.col(name) - lo) / step).cast("int"), F.lit(bins - 1))
        return F.struct(F.lit(name).alias("column_name"), F.when(F.col(name).isNotNull(), inside).alias("bin"))

    places = [place(name, *span) for name, span in spans.items()]
    counts = numbers.select(F.inline(F.array(*places))).where(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(F.count("*").alias("n"))
    return edges.join(counts, ["column_name", "bin"], "left").select("column_name", "bin", "bin_from", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """:func:`histograms` of one value."""
    return histograms(df, {"value": (value, bins)}).drop("column_name")
