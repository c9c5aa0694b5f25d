"""Stored dictionaries of levels: codes that are fitted once, never change, and are applied to later data.

A dictionary is a folder with one table per version: column, level, code. Version 1 holds the sorted levels of the
rows it was fitted on; each further version holds only levels that came later, with codes behind those
that exist. Encoding is a lookup, for ten levels as for a billion: Spark broadcasts a small dictionary and
shuffles a large one. What happens to a level that is not in the dictionary is stated by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.combine import union_all
from offerloom.operators.ordered import running_totals
from offerloom.sources.tables import is_written

Unknown = Literal["null", "other", "error"]
LEVELS = "column_name string, level string, code bigint"
#: Code of all unknown levels under the policy "other".
OTHER = -1


def _version_folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the last complete version, 0 if there is none."""
    version = 0
    while is_written(spark, _version_folder(path, version + 1)):
        version += 1
    return version


def read_dictionary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """column_name, level, code, version of all levels up to a version (default: the last)."""
    last = latest_version(spark, path) if version is None else version
    if not 0 < last <= latest_version(spark, path):
        raise ValueError(f"{path} has no version {version or 1}")
    parts = [
        spark.read.schema(LEVELS).parquet(_version_folder(path, v)).withColumn("version", F.lit(v)) for v in range(1, last + 1)
    ]
    return union_all(parts)


def _numbered(levels: DataFrame, column: str) -> DataFrame:
    """Levels in the order of their type with numbers from 0; ranges of levels are numbered side by side."""
    ranked = running_totals(levels.withColumn("_one", F.lit(1)), column, ["_one"])
    return ranked.select(
        F.lit(column).alias("column_name"), F.col(column).cast("string").alias("level"), F.col("_one_before").cast("bigint").alias("code")
    )


def _present(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def _write(levels: DataFrame, path: str, version: int) -> None:
    levels.write.mode("overwrite").parquet(_version_folder(path, version))


def fit_dictionary(df: DataFrame, columns: Sequence[str], path: str) -> int:
    """Version 1: codes of all levels of ``columns`` in sorted order. An existing dictionary is never fitted anew."""
    if latest_version(df.sparkSession, path):
        raise ValueError(f"{path} is a dictionary already: append to it")
    _write(union_all([_numbered(_present(df, c), c) for c in columns]), path, 1)
    return 1


def append_levels(df: DataFrame, columns: Sequence[str], path: str) -> int:
    """The next version: levels of ``df`` that no version has, sorted, with codes behind the existing ones.

    Without new levels nothing is written. Returns the number of the last version.
    """
    spark = df.sparkSession
    last = latest_version(spark, path)
    known = read_dictionary(spark, path)
    used = {r["column_name"]: r["used"] for r in known.groupBy("column_name").agg(F.count("*").alias("used")).collect()}
    parts = []
    for c in columns:
        levels = known.where(F.col("column_name") == c).select("level")
        new = _present(df, c).join(levels, F.col(c).cast("string") == F.col("level"), "left_anti")
        parts.append(_numbered(new, c).withColumn("code", F.col("code") + F.lit(used.get(c, 0))))
    added = union_all(parts)
    if added.isEmpty():
        return last
    _write(added, path, last + 1)
    return last + 1


def encode(
    df: DataFrame, codes: Mapping[str, str], path: str, unknown: Unknown = "null", version: int | None = None
) -> DataFrame:
    """One code column (bigint) per {column: code column}. NULL stays NULL.

    Unknown levels become NULL, or ``OTHER``, or stop the work. With a stated version, later data and later levels
    change nothing for a model that was fitted on its codes.
    """
    out, table = df, read_dictionary(df.sparkSession, path, version)
    for column, code in codes.items():
        own = table.where(F.col("column_name") == column).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        out = out.join(own, F.col(column).cast("string") == F.col("_level"), "left")
        value = F.col("_code")
        missed = F.col(column).isNotNull() & value.isNull()
        if unknown == "other":
            value = F.when(missed, F.lit(OTHER).cast("bigint")).otherwise(value)
        elif unknown == "error":
            message = F.concat(F.lit(f"{column} has no code for "), F.col(column).cast("string"))
            value = F.when(missed, F.raise_error(message).cast("bigint")).otherwise(value)
        out = out.withColumn(code, value).drop("_level", "_code")
    return out


def unknown_levels(df: DataFrame, columns: Sequence[str], path: str, version: int | None = None) -> DataFrame:
    """column_name, n_levels, n_rows of what a version does not know; every column has a row."""
    table = read_dictionary(df.sparkSession, path, version)
    parts = []
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_level")).agg(F.count("*").alias("n"))
        missed = counts.join(table.where(F.col("column_name") == c), F.col("_level") == F.col("level"), "left_anti")
        sums = missed.agg(F.count("*").alias("n_levels"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        parts.append(sums.select(F.lit(c).alias("column_name"), "n_levels", "n_rows"))
    return union_all(parts)
