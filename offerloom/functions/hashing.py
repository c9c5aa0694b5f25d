"""Deterministic pseudo-random numbers from a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def seeded_hash(key: Column, seed: int, purpose: str) -> Column:
    """A number in [0, 2**32) that depends only on seed, purpose and key.

    It needs no shuffle and no state, gives the same value when a lost task runs
    again, and draws made for different purposes do not go together.
    """
    text = F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def seeded_uniform(key: Column, seed: int, purpose: str) -> Column:
    return seeded_hash(key, seed, purpose) / F.lit(float(HASH_RANGE))
