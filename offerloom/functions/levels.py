"""Clean-up of demographic levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_level(value: Column, old: str, new: str) -> Column:
    return F.when(value == old, F.lit(new)).otherwise(value)


def fill_level(value: Column, level: str) -> Column:
    return F.coalesce(value, F.lit(level))


def impute_demographics() -> dict[str, Column]:
    """Missing children count as none, missing status as Unknown; open-ended levels close."""
    return {
        "no_of_children": replace_level(fill_level(F.col("no_of_children"), "0"), "3+", "3"),
        "marital_status": fill_level(F.col("marital_status"), "Unknown"),
        "family_size": replace_level(F.col("family_size"), "5+", "5"),
    }
