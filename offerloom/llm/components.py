"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.sources.tables import discard, stage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; ``edges`` has two bigint columns, in any direction.

    The component is its smallest node. Each half step sends neighbours to the smallest node nearby;
    a node with very many neighbours only takes part in minima, which are combined before the shuffle,
    and in joins, which Spark splits when a key is frequent. Every round is written to the shared folder.
    """
    a, b = edges.columns
    current = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = stage(current, "edges")
    state = _state(current)
    while True:
        before = current
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where(F.col("u") != F.col("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large, before)
        previous, state = state, _state(current)
        if state == previous:
            roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return roots.unionByName(current.select(F.col("u").alias("node"), F.col("v").alias("component")))
