"""Hold-out and fold assignment from a seeded hash of the row id.

A row's side depends on nothing but its id, so the hash splits need no shuffle and
a task that runs again assigns the same rows to the same side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.hashing import HASH_RANGE, seeded_hash
from offerloom.operators.ordered import rank_by_hash

SEED = 26


def is_holdout(key: Column, fraction: float = 0.25, seed: int = SEED) -> Column:
    return seeded_hash(key, seed, "holdout") < F.lit(int(fraction * HASH_RANGE))


def holdout_split(df: DataFrame, key: str = "id", fraction: float = 0.25, seed: int = SEED) -> DataFrame:
    side = F.when(is_holdout(F.col(key), fraction, seed), "val").otherwise("train")
    return df.withColumn("split", side)


def fold_of(key: Column, n_folds: int = 10, seed: int = SEED) -> Column:
    return (seeded_hash(key, seed, "fold") % n_folds).cast("int")


def kfold(df: DataFrame, key: str = "id", n_folds: int = 10, seed: int = SEED) -> DataFrame:
    """Shuffled folds of about equal size."""
    return df.withColumn("fold", fold_of(F.col(key), n_folds, seed))


def fold_rows(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and rows to score for one fold."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def _ranked(df: DataFrame, key: str, seed: int, groups: Sequence[str]) -> DataFrame:
    hashed = df.withColumn("_hash", seeded_hash(F.col(key), seed, "fold"))
    return rank_by_hash(hashed, "_hash", key, groups)


def kfold_exact(df: DataFrame, key: str = "id", n_folds: int = 10, seed: int = SEED) -> DataFrame:
    """Shuffled folds whose sizes differ by one row at most; the larger ones come first."""
    small = F.floor(F.col("n_rows") / n_folds)
    in_large = (F.col("n_rows") % n_folds) * (small + 1)
    place = F.col("position")
    fold = F.when(place < in_large, F.floor(place / (small + 1))).otherwise(
        F.col("n_rows") % n_folds + F.floor((place - in_large) / F.greatest(small, F.lit(1)))
    )
    return _ranked(df, key, seed, ()).select(*df.columns, fold.cast("int").alias("fold"))


def kfold_stratified(
    df: DataFrame, label: str, key: str = "id", n_folds: int = 10, seed: int = SEED
) -> DataFrame:
    """Shuffled folds with the same share of every label."""
    fold = (F.col("position") % n_folds).cast("int")
    return _ranked(df, key, seed, (label,)).select(*df.columns, fold.alias("fold"))
