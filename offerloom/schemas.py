"""Declared schemas of the campaign tables; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_LONG, _INT, _DOUBLE, _STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

TRAIN = _struct(
    ("id", _LONG),
    ("campaign_id", _INT),
    ("coupon_id", _LONG),
    ("customer_id", _LONG),
    ("redemption_status", _INT),
)
TEST = _struct(("id", _LONG), ("campaign_id", _INT), ("coupon_id", _LONG), ("customer_id", _LONG))
# Dates arrive as text in the files and are parsed with a stated format.
CAMPAIGN = _struct(
    ("campaign_id", _INT), ("campaign_type", _STRING), ("start_date", _STRING), ("end_date", _STRING)
)
COUPON_ITEM = _struct(("coupon_id", _LONG), ("item_id", _LONG))
ITEM = _struct(("item_id", _LONG), ("brand", _LONG), ("brand_type", _STRING), ("category", _STRING))
DEMOGRAPHICS = _struct(
    ("customer_id", _LONG),
    ("age_range", _STRING),
    ("marital_status", _STRING),
    ("rented", _INT),
    ("family_size", _STRING),
    ("no_of_children", _STRING),
    ("income_bracket", _INT),
)
TRANSACTION = _struct(
    ("date", _STRING),
    ("customer_id", _LONG),
    ("item_id", _LONG),
    ("quantity", _DOUBLE),
    ("selling_price", _DOUBLE),
    ("other_discount", _DOUBLE),
    ("coupon_discount", _DOUBLE),
)
SUBMISSION = _struct(("id", _LONG), ("redemption_status", _DOUBLE))
