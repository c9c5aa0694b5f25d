"""Boosted trees as flat arrays: one pass scores all of them and gives the margin after every tree.

A forest is a table of nodes, some hundred per tree, whose size is set by the parameters and not by the rows.
It comes from a saved Spark ML model, can be pruned, and is applied in Arrow batches: all trees of
a batch are walked together, level by level. The plan is one map however many trees there are.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from offerloom.operators.metrics import roc_auc
from offerloom.session import shared_folder, ship_package
from offerloom.sources.tables import remove_folder

AT_ONCE = 1 << 20
#: Rows that are judged in one task at most.
JUDGED_IN_TASK = 250_000
SAMPLE = 4096
BUCKETS = 1024
NODE = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, tree_weight double"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees, one after the other. A leaf leads to itself, so that walking on does no harm.

    ``gain`` is what a split takes off the weighted sum of squares of its rows; leaves have 0.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    tree_weights: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.roots)

    def inner(self) -> np.ndarray:
        return self.left != np.arange(len(self.left))

    def leaves(self) -> list[int]:
        """Number of leaves of each tree."""
        return [int((~part).sum()) for part in np.split(self.inner(), self.roots[1:])]

    def depth(self) -> int:
        """Levels below the deepest root."""
        at, depth = np.unique(self.roots), 0
        while (at := at[self.inner()[at]]).size:
            at, depth = np.concatenate([self.left[at], self.right[at]]), depth + 1
        return depth

    def first(self, trees: int) -> Forest:
        end = self.roots[trees] if trees < self.trees else len(self.value)
        cut = {c: getattr(self, c)[:end] for c in ("feature", "threshold", "left", "right", "value", "gain")}
        return Forest(**cut, roots=self.roots[:trees], tree_weights=self.tree_weights[:trees])

    def tree(self, number: int) -> Forest:
        """One tree alone."""
        begin, end = [*self.roots[number : number + 2], len(self.value)][:2]
        own = {c: getattr(self, c)[begin:end] for c in ("feature", "threshold", "value", "gain")}
        ways = {c: getattr(self, c)[begin:end] - begin for c in ("left", "right")}
        return Forest(**own, **ways, roots=np.zeros(1, np.int64), tree_weights=self.tree_weights[number : number + 1])

    def values(self, x: np.ndarray) -> np.ndarray:
        """Weighted prediction of every tree (columns) for every row of predictors."""
        out, depth = np.empty((len(x), self.trees)), self.depth()
        step = max(1, AT_ONCE // max(1, self.trees))
        for begin in range(0, len(x), step):
            rows = x[begin : begin + step]
            at = np.broadcast_to(self.roots, (len(rows), self.trees)).copy()
            which = np.arange(len(rows))[:, None]
            for _ in range(depth):
                at = np.where(rows[which, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[begin : begin + step] = self.value[at] * self.tree_weights
        return out

    def margins(self, x: np.ndarray, counts: Sequence[int]) -> np.ndarray:
        """Margin after the first n trees, for each n in ``counts``; 0 trees have the margin 0."""
        wanted = list(counts)
        out = np.empty((len(x), len(wanted)))
        step = max(1, AT_ONCE // max(1, self.trees))
        for begin in range(0, len(x), step):
            rows = x[begin : begin + step]
            running = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(self.values(rows), axis=1)], axis=1)
            out[begin : begin + step] = running[:, wanted]
        return out

    def rows(self) -> list[tuple]:
        """The forest as rows of NODE, nodes numbered within their tree."""
        tree = np.searchsorted(self.roots, np.arange(len(self.value)), side="right") - 1
        begin = self.roots[tree]
        left, right = self.left - begin, self.right - begin
        columns = (
            tree, np.arange(len(tree)) - begin, self.feature, self.threshold, left, right, self.value, self.gain,
            self.tree_weights[tree],
        )
        return list(zip(*(c.tolist() for c in columns)))


def of_rows(rows: Sequence[tuple]) -> Forest:
    """A forest from rows of NODE in any order; trees keep the order of their numbers."""
    rows = sorted(rows)
    tree, _, feature, threshold, left, right, value, gain, weight = (
        (np.array(c) for c in zip(*rows)) if rows else [np.zeros(0)] * 9
    )
    _, roots, inverse = np.unique(tree, return_index=True, return_inverse=True)
    begin = roots[inverse] if len(rows) else np.zeros(0, np.int64)
    whole = np.int64
    return Forest(
        feature.astype(whole), threshold.astype(float), left.astype(whole) + begin, right.astype(whole) + begin,
        value.astype(float), gain.astype(float), roots.astype(whole), weight[roots].astype(float),
    )


def joined(parts: Sequence[Forest]) -> Forest:
    """Trees of several forests in a row."""
    parts = [p for p in parts if p.trees]
    if not parts:
        return of_rows([])
    begin = np.cumsum([0, *(len(p.value) for p in parts)])
    moved = {c: np.concatenate([getattr(p, c) + b for p, b in zip(parts, begin)]) for c in ("left", "right", "roots")}
    alike = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("feature", "threshold", "value", "gain", "tree_weights")}
    return Forest(**alike, **moved)


def of_model(spark: SparkSession, model: MLWritable, tree_weights: Sequence[float] | None = None) -> Forest:
    """The trees of a fitted Spark ML ensemble, through its saved form."""
    path = f"{shared_folder(spark)}/models/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["prediction"].alias("value"),
        (node["gain"] * node["impurityStats"][0]).alias("gain"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        node["split"]["leftCategoriesOrThreshold"].alias("border"),
        node["split"]["numCategories"].alias("categories"),
    )
    weights = model.treeWeights if tree_weights is None else tree_weights
    rows = []
    for r in nodes.collect():  # nodes of one model
        leaf = r["left"] < 0
        if not leaf and r["categories"] >= 0:
            raise ValueError("trees with categorical splits are not flattened")
        split = (0, 0.0, r["node"], r["node"], r["value"], 0.0) if leaf else (
            r["feature"], r["border"][0], r["left"], r["right"], r["value"], r["gain"]
        )
        rows.append((r["tree"], r["node"], *split, float(weights[r["tree"]])))
    remove_folder(spark, path)
    return of_rows(rows)


def pruned(forest: Forest, max_leaves: int | None = None, min_gain: float = 0.0) -> Forest:
    """Smaller trees: at most ``max_leaves`` by best-first growth, then splits under ``min_gain`` taken back.

    A split of a node hangs on the rows of the node alone. So the tree that grows by always splitting the leaf
    with the largest gain is a part of the full tree: it is walked from the root in that order until the
    leaves are used up (equal gains: the smaller node first). After that, from the bottom up, a split
    whose children are leaves and whose gain is under ``min_gain`` is undone.
    """
    left, right = forest.left.copy(), forest.right.copy()
    inner, own = forest.inner(), np.arange(len(forest.left))
    for root in forest.roots:
        if max_leaves is not None:
            open_, leaves, kept = [], 1, set()
            if inner[root]:
                heapq.heappush(open_, (-forest.gain[root], root))
            while open_ and leaves < max_leaves:
                _, node = heapq.heappop(open_)
                kept.add(node)
                leaves += 1
                for child in (left[node], right[node]):
                    if inner[child]:
                        heapq.heappush(open_, (-forest.gain[child], child))
            for _, node in open_:
                left[node] = right[node] = node
    if min_gain > 0:
        # children have larger numbers than their parent
        for node in own[::-1]:
            if left[node] != node and forest.gain[node] < min_gain:
                if left[left[node]] == left[node] and left[right[node]] == right[node]:
                    left[node] = right[node] = node
    is_leaf = left == own
    reached = np.zeros(len(own), bool)
    reached[forest.roots] = True
    for node in own:
        if reached[node] and not is_leaf[node]:
            reached[[left[node], right[node]]] = True
    number = np.cumsum(reached) - 1
    cut = {c: getattr(forest, c)[reached] for c in ("feature", "threshold", "value")}
    gain = np.where(is_leaf, 0.0, forest.gain)[reached]
    return replace(
        forest, **cut, gain=gain, left=number[left[reached]], right=number[right[reached]], roots=number[forest.roots]
    )


def gain_importances(forest: Forest, n_features: int) -> np.ndarray:
    """Share of each predictor in the gains of all splits."""
    total = np.bincount(forest.feature[forest.inner()], forest.gain[forest.inner()], minlength=n_features)
    return total / total.sum() if total.sum() else total


def _predictors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def add_margins(forest: Forest, rows: DataFrame, counts: Sequence[int], name: str = "margins") -> DataFrame:
    """``features`` replaced by an array: the margin after the first n trees for each n in ``counts``."""
    ship_package(rows.sparkSession)
    rest = [f for f in rows.schema.fields if f.name != "features"]
    wanted = list(counts)

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            margins = forest.margins(_predictors(part.column("__x")), wanted)
            lists = pa.ListArray.from_arrays(
                np.arange(part.num_rows + 1, dtype=np.int32) * np.int32(len(wanted)), margins.ravel()
            )
            yield pa.RecordBatch.from_pydict({f.name: part.column(f.name) for f in rest} | {name: lists})

    plain = rows.select(*[f.name for f in rest], vector_to_array("features").alias("__x"))
    schema = StructType([*rest, StructField(name, ArrayType(DoubleType()))])
    return plain.mapInArrow(walk, schema)


def add_margin(forest: Forest, rows: DataFrame, name: str = "margin") -> DataFrame:
    """The margin of all trees as one more column, predictors kept."""
    beside = rows.withColumn("__features", F.col("features"))
    out = add_margins(forest, beside, [forest.trees], "__m")
    return out.select(*[F.col("__features").alias(c) if c == "features" else c for c in rows.columns], F.col("__m")[0].alias(name))


def long_margins(forest: Forest, rows: DataFrame, counts: Sequence[int]) -> DataFrame:
    """One row per row and number of trees (``n_trees``, ``margin``)."""
    wanted = sorted(set(counts))
    kept = [c for c in rows.columns if c != "features"]
    each = add_margins(forest, rows, wanted, "__m").select(*kept, F.posexplode("__m").alias("__i", "margin"))
    return each.select(*kept, F.get(F.lit(wanted), "__i").cast("int").alias("n_trees"), "margin")


def auc_bounds(
    forest: Forest, rows: DataFrame, counts: Sequence[int], target: str, buckets: int = BUCKETS, sample: int = SAMPLE
) -> dict[int, tuple[float, float]]:
    """(lowest, highest) possible AUC after the first n trees, for every n in ``counts``, in one pass over ``rows``.

    For each n the margins are counted by class and bucket inside the tasks; what is shuffled are at most
    2 x ``buckets`` counts per n and task, however many rows there are. Each border is a bucket of its own, and
    so is what lies between two. Pairs in different buckets are ordered and pairs on a border are ties; a pair
    between two borders counts for nothing in the lower and fully in the upper bound. Borders are quantiles over
    ``sample`` rows, those with the smallest hash; they decide how close the bounds are and not whether they hold.
    """
    wanted = sorted(set(counts))
    judged = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("int").alias("__y"), "features")
    x = F.col("__x")
    some = judged.select(vector_to_array("features").alias("__x")).orderBy(F.xxhash64(x)).limit(sample).collect()
    if not some or not wanted:
        return {}
    known = forest.margins(np.array([r["__x"] for r in some], float), wanted)
    borders = [np.unique(np.quantile(m, np.arange(1, buckets) / buckets, method="lower")) for m in known.T]
    ship_package(rows.sparkSession)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(wanted), 2 * buckets + 1, 2), np.int64)
        for part in parts:
            y = part.column("__y").to_numpy().astype(np.int64)
            margins = forest.margins(_predictors(part.column("__x")), wanted)
            for i, border in enumerate(borders):
                m = margins[:, i]
                at = np.searchsorted(border, m) + np.searchsorted(border, m, side="right")  # odd on a border
                total[i] += np.bincount(2 * at + y, minlength=total[i].size).reshape(-1, 2)
        i, bucket = np.nonzero(total.any(axis=2))
        found = {"i": i, "bucket": bucket, "neg": total[i, bucket, 0], "pos": total[i, bucket, 1]}
        yield pa.RecordBatch.from_pydict({k: v.astype(np.int64) for k, v in found.items()})

    schema = StructType([StructField(c, LongType()) for c in ("i", "bucket", "neg", "pos")])
    plain = judged.select("__y", vector_to_array("features").alias("__x"))
    tables = plain.mapInArrow(count, schema).groupBy("i", "bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counted = np.zeros((len(wanted), 2 * buckets + 1, 2))
    for r in tables.collect():  # candidates x buckets
        counted[r["i"], r["bucket"]] = r["neg"], r["pos"]
    found = {}
    for n, table in zip(wanted, counted):
        (neg, pos), all_pairs = table.T, table[:, 0].sum() * table[:, 1].sum()
        if all_pairs:
            same = pos * neg
            low = (pos * (np.cumsum(neg) - neg)).sum() + same[1::2].sum() / 2
            found[n] = float(low / all_pairs), float((low + same[::2].sum()) / all_pairs)
    return found


def task_aucs(forest: Forest, rows: DataFrame, counts: Sequence[int], target: str) -> dict[int, float]:
    """Exact AUC after the first n trees for very many n, on up to JUDGED_IN_TASK rows: one task walks tree by tree and sorts the margins."""
    ship_package(rows.sparkSession)
    wanted = sorted(set(counts))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [(_predictors(p.column("__x")), p.column("__y").to_numpy()) for p in parts if p.num_rows]
        if not some:
            return
        x, y = (np.concatenate(c) for c in zip(*some))
        all_pairs = 2.0 * float(y.sum()) * float(len(y) - y.sum())
        found: list[tuple[int, float]] = []
        running, done = np.zeros((len(x), 1)), 0
        for n in wanted if all_pairs else []:
            while done < n:  # as Forest.margins adds up
                running += forest.tree(done).values(x)
                done += 1
            order = np.argsort(running[:, 0])
            margin, pos = running[order, 0], y[order].astype(np.int64)
            begin = np.flatnonzero(np.diff(margin, prepend=-np.inf) != 0)
            p = np.add.reduceat(pos, begin)
            neg = np.diff(np.append(begin, len(pos))) - p
            found.append((n, float((p * (2 * (np.cumsum(neg) - neg) + neg)).sum()) / all_pairs))
        ns, aucs = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_pydict({"n_trees": pa.array(ns, pa.int64()), "auc": pa.array(aucs, pa.float64())})

    judged = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("int").alias("__y"), vector_to_array("features").alias("__x"))
    schema = StructType([StructField("n_trees", LongType()), StructField("auc", DoubleType())])
    return {r["n_trees"]: r["auc"] for r in judged.repartition(1).mapInArrow(judge, schema).collect()}  # one row per n


def exact_aucs(forest: Forest, rows: DataFrame, counts: Sequence[int], target: str) -> dict[int, float]:
    """Exact AUC after the first n trees; rows are written once per n, so this is for few of them."""
    if not counts:
        return {}
    judged = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("int").alias(target), "features")
    table = roc_auc(long_margins(forest, judged, counts), target, "margin", ["n_trees"])
    return {r["n_trees"]: r["auc"] for r in table.collect() if r["auc"] is not None}  # one row per n
