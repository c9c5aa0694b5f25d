"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and by a ring of distances around it. From the pivot, the
ring's largest distance and its largest norm, the triangle inequality bounds the score of any vector
in the ring. A query first opens the ring with the highest bound that holds enough vectors; its k-th
score there is a floor. It then opens further rings in order of their bounds and stops where the bound
falls below the floor. Vectors outside cannot be among the best, so the answer is exact.

Pivots and ring borders are taken from a bounded sample (``SAMPLE`` vectors, those with the smallest
hash of their id); every vector is indexed. They decide how much is opened, never the answer. Rings
are cut into blocks of some ``BLOCK`` vectors by a hash of the id, and the queries into blocks of as
many, so no task holds a ring or all queries, also where one vector is repeated very often.

Defined results: components become floor(256 * x). Vectors that are null, or hold a null, NaN or
infinite component, and rows without id take no part. A shorter vector is filled up with zeros, and the
empty vector scores 0 with all. Of rows with the same id the smallest vector stays. Equal scores
go to the smaller id. With fewer than k other vectors all are returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import ship
from offerloom.sources.tables import stage

SAMPLE = 4096
PIVOTS = 16
RINGS = 8
BLOCK = 2048
EXACT = 1 << 53


def whole_numbers(vector: str) -> Column:
    return F.transform(vector, lambda e: F.floor(F.lit(256.0) * e.cast("double")))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): one row per id, whole-number components."""
    e = F.col(vector)
    bad = F.exists(
        vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf")))
    )
    rows = vectors.where(e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("bigint").alias("vec_id"), whole_numbers(vector).alias("x")).groupBy(
        "vec_id"
    ).agg(F.min("x").alias("x"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    largest = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if largest < EXACT:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return (left.astype(object) @ right.astype(object).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) of one query among the vectors of a block."""
    allowed = ids != own
    ids, scores = ids[allowed], scores[allowed]
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= floor
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector that is farthest from those before it."""
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(PIVOTS, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def place(x: np.ndarray, pivots: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot, distance to it, and ring of each vector."""
    gaps = np.linalg.norm(x[:, None, :].astype(float) - pivots[None, :, :], axis=2)
    nearest = gaps.argmin(axis=1)
    distance = gaps[np.arange(len(x)), nearest]
    return nearest, distance, (distance[:, None] > borders[nearest]).sum(axis=1)


def bounds(x: np.ndarray, rings: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each query with any vector of each ring, rounding errors included."""
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1)[:, None]
    centre = pivots[rings["pivot"].to_numpy()]
    gap = np.linalg.norm(x[:, None, :] - centre[None, :, :], axis=2)
    near, far = rings.near.to_numpy(), rings.far.to_numpy()
    apart = np.maximum(0, np.maximum(gap - far, near - gap))
    by_distance = (norm**2 + rings.norm.to_numpy() ** 2 - apart**2) / 2
    bound = np.minimum(by_distance, x @ centre.T + norm * far)
    return bound + 1 + 1e-9 * (norm**2 + rings.norm.to_numpy() ** 2)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for every vector that ``queries`` (on vec_id) picks."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stage(usable(vectors, id_column, vector), "vectors")
    total, width, wanted = rows.agg(
        F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count(F.when(queries, 1))
    ).first()
    sample = matrix([r["x"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], width)
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose_pivots(sample.astype(float))
    nearest, distance, _ = place(sample, pivots, np.zeros((len(pivots), 1)))
    borders = np.array(
        [np.quantile(distance[nearest == p], np.arange(1, RINGS) / RINGS) for p in range(len(pivots))]
    )

    def keyed(frames):
        for frame in frames:
            x = matrix(frame.x, width)
            nearest, distance, ring = place(x, pivots, borders)
            norm = np.linalg.norm(x.astype(float), axis=1)
            yield frame.assign(pivot=nearest, ring=ring, distance=distance, norm=norm)

    index = stage(
        rows.mapInPandas(keyed, "vec_id bigint, x array<bigint>, pivot int, ring int, distance double, norm double"),
        "pivot-index",
    )
    # PIVOTS * RINGS rows at most
    rings = (
        index.groupBy("pivot", "ring")
        .agg(
            F.count("*").alias("n"),
            F.min("distance").alias("near"),
            F.max("distance").alias("far"),
            F.max("norm").alias("norm"),
        )
        .orderBy("pivot", "ring")
        .toPandas()
    )
    rings["chunks"] = -(-rings.n // BLOCK)
    groups = max(1, -(-wanted // BLOCK))
    asked = index.where(queries).select(
        F.col("vec_id").alias("query_id"), "x", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part")
    )
    chunk_table = spark.createDataFrame(rings[["pivot", "ring", "chunks"]], "pivot int, ring int, chunks int")
    spread = index.join(F.broadcast(chunk_table), ["pivot", "ring"]).select(
        "pivot", "ring", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "x"
    )
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def open_rings(requests: DataFrame) -> DataFrame:
        """Scores of the k best vectors per block that a query opens; requests: query_id, x, part, opened rings."""
        wide = requests.withColumn("n", F.explode("opened")).drop("opened")
        numbers = chunk_table.withColumn("n", F.col("pivot") * RINGS + F.col("ring"))
        wide = wide.join(F.broadcast(numbers), "n").withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))
        )
        key = ["pivot", "ring", "chunk", "part"]

        def block(vectors: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(vectors) and len(asking):
                ids = vectors.vec_id.to_numpy()
                scores = products(matrix(asking.x, width), matrix(vectors.x, width))
                for query, line in zip(asking.query_id, scores):
                    found += [(query, i, s) for i, s in best(line, ids, query, k)]
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

        left = spread.select(*key, "vec_id", "x").groupBy(*key)
        right = wide.select(*key, "query_id", "x").groupBy(*key)
        return left.cogroup(right).applyInPandas(block, "query_id bigint, vec_id bigint, score bigint")

    def first_ring(frames):
        for frame in frames:
            bound = bounds(matrix(frame.x, width), rings, pivots)
            enough = rings.n.to_numpy() > k
            bound[:, ~enough] = -np.inf if enough.any() else bound[:, ~enough]
            numbers = (rings["pivot"] * RINGS + rings["ring"]).to_numpy()
            yield frame.assign(opened=[[int(numbers[i])] for i in bound.argmax(axis=1)])

    schema = "query_id bigint, x array<bigint>, part int, opened array<int>"
    first = stage(asked.mapInPandas(first_ring, schema), "first-rings")
    begun = stage(open_rings(first), "first-scores")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = (
        begun.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    )

    def further_rings(frames):
        for frame in frames:
            bound = bounds(matrix(frame.x, width), rings, pivots)
            numbers = (rings["pivot"] * RINGS + rings["ring"]).to_numpy()
            floor = frame["floor"].astype(float).fillna(-np.inf).to_numpy()
            opened = [
                [int(n) for n in numbers[line >= low] if n != done[0]] for line, low, done in zip(bound, floor, frame.opened)
            ]
            yield frame.drop(columns="floor").assign(opened=opened)

    rest = first.join(floors, "query_id", "left").mapInPandas(further_rings, schema)
    found = begun.unionByName(open_rings(rest))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
