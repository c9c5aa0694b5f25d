"""CSV that may be faulty: good rows in one table, rejected ones with file, text and reason in another."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from offerloom.sources.tables import stage

WHOLE_ROW = "(row)"


class Checked(NamedTuple):
    rows: DataFrame
    #: file, row_text, column_name ('(row)' for the whole row), value, reason
    rejects: DataFrame


class TooManyRejects(ValueError):
    pass


def _typed(field: StructField, date_formats: Mapping[str, str]) -> Column:
    """The value in its type, NULL where the text is none."""
    text = F.trim(F.col(field.name))
    if isinstance(field.dataType, DateType):
        pattern = date_formats.get(field.name, "yyyy-MM-dd")
        day = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
        # the text has to be the day in the stated form, not something a parser makes a day of
        return F.when(F.date_format(day, pattern) == text, day)
    return F.col(field.name).try_cast(field.dataType) if isinstance(field.dataType, StringType) else text.try_cast(field.dataType)


def read_checked(
    spark: SparkSession,
    path: str,
    schema: StructType,
    date_formats: Mapping[str, str] | None = None,
    header: bool = True,
    most_rejects: int | None = None,
) -> Checked:
    """Read CSV without losing a bad row or stopping at it.

    A row with too few or too many values is rejected as a whole; of others, each value that is not of its column's
    type, or missing where the schema allows no NULL, is one reject. A row with a reject is not among ``rows``.
    More rejected values than ``most_rejects`` stop the work. The text is parsed once: both tables come from one stage.
    """
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields] + [StructField("_bad", StringType())])
    raw = (
        spark.read.schema(texts)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("enforceSchema", True)
        .csv(path)
    )
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1)
    raw = raw.select("*", file.alias("_file"))
    values = {f.name: _typed(f, date_formats or {}) for f in schema.fields}

    def fault(f: StructField) -> Column:
        given = F.col(f.name).isNotNull() & (F.trim(f.name) != "")
        reason = F.when(given & values[f.name].isNull(), F.lit(f"not of type {f.dataType.simpleString()}"))
        if not f.nullable:
            reason = reason.when(~given, F.lit("missing"))
        return F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("value"), reason.alias("reason"))

    whole = F.struct(F.lit(WHOLE_ROW).alias("column_name"), F.col("_bad").alias("value"), F.lit("number of values").alias("reason"))
    faults = F.filter(F.array(*[fault(f) for f in schema.fields]), lambda x: x["reason"].isNotNull())
    faults = F.when(F.col("_bad").isNotNull(), F.array(whole)).otherwise(faults)
    checked = raw.select(
        "_file",
        F.coalesce("_bad", F.to_csv(F.struct(*[f.name for f in schema.fields]))).alias("_text"),
        faults.alias("_faults"),
        *[v.alias(name) for name, v in values.items()],
    )
    checked = stage(checked, "checked")
    rejects = checked.where(F.size("_faults") > 0).select(
        F.col("_file").alias("file"), F.col("_text").alias("row_text"), F.inline("_faults")
    )
    if most_rejects is not None and (n := rejects.count()) > most_rejects:
        raise TooManyRejects(f"{n} values of {path} were rejected, {most_rejects} are allowed")
    return Checked(checked.where(F.size("_faults") == 0).select(*[f.name for f in schema.fields]), rejects)


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected values per file, column and reason."""
    return rejects.groupBy("file", "column_name", "reason").agg(F.count("*").alias("n"))
