"""Money transforms and score arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_price(value: Column) -> Column:
    return F.log1p(value)


def log_discount(value: Column) -> Column:
    """Log of a squared amount: discounts are negative, so the sign is squared away."""
    return F.log1p(value * value)


def blend(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of scores, one weight per score."""
    if len(scores) != len(weights):
        raise ValueError("one weight per score is needed")
    total = scores[0] * F.lit(float(weights[0]))
    for score, weight in zip(scores[1:], weights[1:]):
        total = total + score * F.lit(float(weight))
    return total


def hard_class(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability > threshold, 1).when(probability.isNotNull(), 0)
