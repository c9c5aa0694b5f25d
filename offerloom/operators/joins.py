"""Left joins onto tables with one row per key.

No join carries a broadcast hint. Spark broadcasts a side when the size it knows
(file size of a staged table, or the shuffle size seen while running) is below
``spark.sql.autoBroadcastJoinThreshold``; above it, both sides are shuffled by key
and adaptive execution cuts a partition that holds a hot key into several tasks,
copying only the one lookup row. Neither way depends on how the keys are spread.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def lookup(rows: DataFrame, table: DataFrame, key: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Add the columns of ``table`` to ``rows``; ``table`` has each key at most once.

    ``rename`` gives columns of ``table`` new names first, so that no name collides.
    """
    right = table.withColumnsRenamed(dict(rename or {}))
    clash = (set(rows.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides, rename them first: {sorted(clash)}")
    return rows.join(right, key, "left")
