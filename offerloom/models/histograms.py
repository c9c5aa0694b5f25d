"""Boosting on binned rows: the trees of ``GBTClassifier`` for very many trees or very many rows.

Spark ML starts several jobs for every level of every tree, some 1.7 s a tree however few the rows, and keeps some 1.4 KB a row.
Here rows become codes where they lie, a byte a column. What a table of up to ``ROWS_IN_TASK`` rows needs fits into one task, which
grows all trees of a fit; fits of several folds run beside each other. A longer table is staged in codes, and every level
of a tree is one pass that counts and sums in streams; only histograms go to the driver, and of two children only the smaller is counted.

Splits, gains, leaves, steps and pseudo-residuals are those of ``GBTClassifier``: without sampling the trees are the same. Borders
of bins come from all rows (Spark takes a sample of 10,000). Rows and predictors are drawn by seeded hashes and generators of
this module, so a task that runs again draws the same.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from offerloom.models.forest import Forest, _predictors, joined, pruned
from offerloom.session import ship_package
from offerloom.sources.tables import discard, session_beside, stage

#: Most rows of a fit in one task: some 0.2 GB with 48 predictors.
ROWS_IN_TASK = 1_000_000
#: Coded rows that lie in one value, and how many such values Spark hands over at a time.
CHUNK_ROWS = 16384
CHUNKS_AT_ONCE = 16
BINS = 32
#: Values of a predictor that a task keeps apart for the borders; beyond that, as many weighted quantiles.
VALUES = 4096
CHUNK = 4096
#: What a split must take off the weighted sum of squares, as a share of the weight of its rows: less is rounding.
LEAST_SHARE = 1e-12

Counter = Callable[["Tree", np.ndarray], list[np.ndarray]]


def _summary(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights, or ``VALUES`` of them that stand for their neighbours."""
    found, at = np.unique(values, return_inverse=True)
    total = np.bincount(at, weights, minlength=len(found))
    if len(found) <= VALUES:
        return found, total
    upto = np.cumsum(total)
    group = np.minimum((upto - total / 2) * VALUES // upto[-1], VALUES - 1).astype(np.int64)
    ends = np.flatnonzero(np.diff(group, append=VALUES))
    return found[ends], np.diff(upto[ends], prepend=0.0)


def borders_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Borders of at most ``BINS`` bins, as Spark ML sets them: between all values, or where a bin has its share of the weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < BINS:
        return middle
    stride = weights.sum() / BINS
    found, target, running = [], stride, weights[0]
    for i in range(1, len(values)):
        before, running = running, running + weights[i]
        if abs(before - target) < abs(running - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


class Layout:
    """How predictors become codes: one column each, but dummies of which no row has two share a column.

    ``meet`` says of each two predictors whether a row has 1 in both. The splits are listed by predictor and border.
    """

    def __init__(self, cuts: Sequence[np.ndarray], dummy: Sequence[bool], meet: np.ndarray) -> None:
        self.cuts, self.n_features = list(cuts), len(cuts)
        self.wide = [f for f, c in enumerate(cuts) if len(c) and not dummy[f]]
        self.groups: list[list[int]] = []
        for f in np.flatnonzero(np.array(dummy, bool)):
            free = (g for g in self.groups if len(g) < BINS - 1 and not meet[f, g].any())
            group = next(free, None)
            if group is None:
                self.groups.append(group := [])
            group.append(int(f))
        self.width = max(1, len(self.wide) + len(self.groups))
        splits = [(f, b, c, b, 0) for c, f in enumerate(self.wide) for b in range(len(cuts[f]))]
        for c, group in enumerate(self.groups, len(self.wide)):
            splits += [(f, 0, c, code, 1) for code, f in enumerate(group, 1)]
        table = np.array(sorted(splits), np.int64).reshape(-1, 5)
        self.feature, self.column, self.code = table[:, 0], table[:, 2], table[:, 3]
        self.shared = table[:, 4].astype(bool)
        self.threshold = np.array([cuts[f][b] for f, b in table[:, :2]], float)
        self.slot = self.column * BINS + self.code

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width), np.uint8)
        for c, f in enumerate(self.wide):
            out[:, c] = np.searchsorted(self.cuts[f], x[:, f])
        for c, group in enumerate(self.groups, len(self.wide)):
            for code, f in enumerate(group, 1):
                out[x[:, f] > self.cuts[f][0], c] = code
        return out


def layout_of(labelled: DataFrame) -> Layout:
    """One pass over ``features`` and ``weight``: borders of all predictors, and which dummies ever meet."""

    def summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for part in parts:
            if not part.num_rows:
                continue
            x, w = _predictors(part.column("__x")), part.column("weight").to_numpy()
            if not kept:
                kept = [(np.zeros(0), np.zeros(0))] * x.shape[1]
                meet = np.zeros((x.shape[1], x.shape[1]))
            one = x == 1
            bits = one.astype(np.float32)
            meet += bits.T @ bits
            plain = (one | (x == 0)).all(axis=0)
            for f, (values, weights) in enumerate(kept):
                if plain[f]:
                    ones = w[one[:, f]].sum()
                    found, total = np.array([0.0, 1.0]), np.array([w.sum() - ones, ones])
                    found, total = found[total > 0], total[total > 0]
                else:
                    found, total = x[:, f], w
                kept[f] = _summary(np.concatenate([values, found]), np.concatenate([weights, total]))
        columns = {
            "feature": pa.array(range(len(kept)), pa.int32()),
            "found": pa.array([v.tobytes() for v, _ in kept], pa.binary()),
            "total": pa.array([t.tobytes() for _, t in kept], pa.binary()),
            "meet": pa.array([meet[f].tobytes() for f in range(len(kept))], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(columns)

    ship_package(labelled.sparkSession)
    blobs = [StructField(c, BinaryType()) for c in ("found", "total", "meet")]
    plain = labelled.select(vector_to_array("features").alias("__x"), "weight")
    by_feature: dict[int, list] = {}
    for r in plain.mapInArrow(summarise, StructType([StructField("feature", IntegerType()), *blobs])).collect():  # tasks x predictors
        by_feature.setdefault(r["feature"], []).append([np.frombuffer(r[c.name]) for c in blobs])
    if not by_feature:
        raise ValueError("no rows to fit on")
    cuts, dummy, meet = [], [], []
    for feature in sorted(by_feature):
        found, total, met = zip(*by_feature[feature])
        values, at = np.unique(np.concatenate(found), return_inverse=True)
        cuts.append(borders_of(values, np.bincount(at, np.concatenate(total))))
        dummy.append(values.tolist() == [0.0, 1.0])
        meet.append(sum(met) > 0)
    return Layout(cuts, dummy, np.array(meet))


class Tree:
    """A growing tree; ``split`` is a row of the layout's splits, and a node that is not split leads to itself."""

    def __init__(self) -> None:
        self.split, self.left, self.right = (np.zeros(1, np.int64) for _ in range(3))
        self.value, self.gain, self.level = np.zeros(1), np.zeros(1), np.zeros(1, np.int64)

    def expand(self, nodes: np.ndarray, split: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Give every one of ``nodes`` two children, left and right in turn; their numbers."""
        first, more = len(self.split), 2 * len(nodes)
        made = np.arange(first, first + more)
        self.split[nodes], self.gain[nodes] = split, gain
        self.left[nodes], self.right[nodes] = made[::2], made[1::2]
        self.split = np.append(self.split, np.zeros(more, np.int64))
        self.left, self.right = np.append(self.left, made), np.append(self.right, made)
        self.value, self.gain = np.append(self.value, np.zeros(more)), np.append(self.gain, np.zeros(more))
        self.level = np.append(self.level, np.repeat(self.level[nodes] + 1, 2))
        return made

    def step(self, layout: Layout, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows are not in a leaf yet; those go one level down, in place."""
        going = np.flatnonzero(self.left[at] != at)
        node = at[going]
        split = self.split[node]
        code, border = codes[going, layout.column[split]], layout.code[split]
        right = np.where(layout.shared[split], code == border, code > border)
        at[going] = np.where(right, self.right[node], self.left[node])
        return going

    def leaf(self, layout: Layout, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        while self.step(layout, codes, at).size:
            pass
        return at

    def forest(self, layout: Layout, weight: float) -> Forest:
        inner = self.left != np.arange(len(self.left))
        feature = np.where(inner, layout.feature[self.split] if len(layout.feature) else 0, 0)
        threshold = np.where(inner, layout.threshold[self.split] if len(layout.feature) else 0.0, 0.0)
        return Forest(feature, threshold, self.left, self.right, self.value, self.gain, np.zeros(1, np.int64), np.array([weight]))


def _next_best(tree: Tree, best: dict[int, tuple], leaves: int) -> list[int]:
    """Nodes that best-first growth to ``leaves`` leaves would split next, by what is known so far.

    Children that have not been counted are passed over, so a node too many can be among them; when there is none left, the
    tree of best-first growth is a part of this one, and ``forest.pruned`` cuts it out.
    """
    heap, wanted, left = [(-best[0][0], 0)] if 0 in best else [], [], leaves - 1
    while heap and left:
        _, node = heapq.heappop(heap)
        left -= 1
        if tree.left[node] == node:
            wanted.append(node)
        else:
            for child in (int(tree.left[node]), int(tree.right[node])):
                if child in best:
                    heapq.heappush(heap, (-best[child][0], child))
    return wanted


def grow(count: Counter, layout: Layout, params: dict, number: int) -> Tree:
    """One tree. ``count`` gives, for the tree so far and some of its nodes, the histograms of the rows in these nodes.

    Without a limit on leaves all nodes of a level are split at once.
    """
    tree = Tree()
    drawn = np.random.default_rng([params["seed"], number])
    extra = params["positive_weight"] - 1.0
    wanted = math.ceil(params["feature_share"] * layout.n_features)
    best: dict[int, tuple] = {}  # gain and split of counted nodes that can be split, kept until that is done
    kept: dict[int, list[np.ndarray]] = {}
    new, hist = np.zeros(1, np.int64), count(tree, np.zeros(1, np.int64))
    while True:
        rows, total = hist[0], hist[1]
        weight = rows + extra * hist[2] if extra else rows
        n, w, s = (h[:, 0, :].sum(axis=1) for h in (rows, weight, total))
        if new[0] == 0 and w[0]:
            tree.value[0] = s[0] / w[0]
        if len(layout.feature):
            halves = []
            for h, whole in ((rows, n), (weight, w), (total, s)):
                own = h.reshape(len(new), -1)[:, layout.slot]
                upto = np.cumsum(h, axis=2).reshape(len(new), -1)[:, layout.slot]
                halves.append(np.where(layout.shared, whole[:, None] - own, upto))
            left_n, left_w, left_s = halves
            allowed = (left_n >= params["min_rows"]) & (n[:, None] - left_n >= params["min_rows"])
            if wanted < layout.n_features:
                place = drawn.random((len(new), layout.n_features)).argsort(axis=1).argsort(axis=1)
                allowed &= (place < wanted)[:, layout.feature]
            with np.errstate(divide="ignore", invalid="ignore"):
                right_w, right_s = w[:, None] - left_w, s[:, None] - left_s
                gain = left_s**2 / left_w + right_s**2 / right_w - (s**2 / w)[:, None]
            gain = np.where(allowed, gain, -np.inf)
            split = gain.argmax(axis=1)
            for i, b in enumerate(split):
                if gain[i, b] > LEAST_SHARE * w[i]:
                    sides = (left_n[i, b], n[i], left_s[i, b] / left_w[i, b], right_s[i, b] / right_w[i, b])
                    best[int(new[i])] = (float(gain[i, b]), int(b), *sides)
                    kept[int(new[i])] = [h[i] for h in hist]
        if params["leaves"]:
            chosen = _next_best(tree, best, params["leaves"])
        else:
            chosen = [node for node in best if tree.left[node] == node]
        if not chosen:
            return tree
        made = tree.expand(np.array(chosen), np.array([best[c][1] for c in chosen]), np.array([best[c][0] for c in chosen]))
        tree.value[made] = [v for c in chosen for v in best[c][4:]]
        # rows of the smaller child are counted, the other one is the rest of the parent
        deep = [i for i, c in enumerate(chosen) if tree.level[c] + 1 < params["depth"]]
        if not deep:
            return tree
        left_is_small = np.array([2 * best[chosen[i]][2] <= best[chosen[i]][3] for i in deep])
        pairs = made.reshape(-1, 2)[deep]
        small = np.where(left_is_small, pairs[:, 0], pairs[:, 1])
        counted = count(tree, small)
        new = pairs.ravel()
        hist = []
        for k, c in enumerate(counted):
            rest = np.stack([kept[chosen[i]][k] for i in deep]) - c
            left = left_is_small[:, None, None]
            both = np.stack([np.where(left, c, rest), np.where(left, rest, c)], axis=1)
            hist.append(both.reshape(len(new), layout.width, BINS))
        for c in chosen:
            kept.pop(c)


def histograms(layout: Layout, codes: np.ndarray, place: np.ndarray, places: int, positive: np.ndarray | None, value: np.ndarray) -> list[np.ndarray]:
    """Per (place, column, code): rows, sum of ``value`` and, if they are given, positive rows."""
    slots = places * layout.width * BINS
    offset = np.arange(layout.width) * BINS
    out = [np.zeros(slots) for _ in range(2 if positive is None else 3)]
    for begin in range(0, len(codes), CHUNK):
        part = slice(begin, begin + CHUNK)
        keys = codes[part] + (offset + place[part, None] * (layout.width * BINS))
        flat = keys.ravel()
        out[0] += np.bincount(flat, minlength=slots)
        out[1] += np.bincount(flat, np.repeat(value[part], layout.width), minlength=slots)
        if positive is not None:
            out[2] += np.bincount(keys[positive[part]].ravel(), minlength=slots)
    return [t.reshape(places, layout.width, BINS) for t in out]


def residuals(positive: np.ndarray, margin: np.ndarray, number: int) -> np.ndarray:
    """What tree ``number`` is fitted to: the class, and then four times the gradient of the log loss."""
    y = np.where(positive, 1.0, -1.0)
    return y if number == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def is_drawn(draw: np.ndarray, number: int, params: dict) -> np.ndarray:
    """Whether rows with these hashes are in the sample of a tree."""
    if params["row_share"] >= 1:
        return np.ones(len(draw), bool)
    with np.errstate(over="ignore"):
        mixed = draw.view(np.uint64) + np.uint64((params["seed"] * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))) < np.uint64(int(params["row_share"] * 2**64))


def step_of(params: dict, number: int) -> float:
    return 1.0 if number == 0 else params["step"]


def grow_all(layout: Layout, codes: np.ndarray, positive: np.ndarray, draw: np.ndarray, params: dict) -> list[Tree]:
    """All trees of a fit whose rows are here."""
    order = np.argsort(draw, kind="stable")  # sums are the same in whatever order rows come
    codes, positive, draw = codes[order], positive[order], draw[order]
    margin, trees = np.zeros(len(codes)), []
    for number in range(params["trees"]):
        residual = residuals(positive, margin, number)
        weighted = residual * np.where(positive, params["positive_weight"], 1.0)
        sampled, at = is_drawn(draw, number, params), np.zeros(len(codes), np.int64)

        def count(tree: Tree, wanted: np.ndarray) -> list[np.ndarray]:
            tree.step(layout, codes, at)
            place = np.full(len(tree.left), -1)
            place[wanted] = np.arange(len(wanted))
            of_rows = place[at]
            use = np.flatnonzero((of_rows >= 0) & sampled)
            pos = positive[use] if params["positive_weight"] != 1 else None
            return histograms(layout, codes[use], of_rows[use], len(wanted), pos, weighted[use])

        tree = grow(count, layout, params, number)
        tree.step(layout, codes, at)
        margin += tree.value[at] * step_of(params, number)
        trees.append(tree)
    return trees


ARRAYS = {
    "feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float, "gain": float, "roots": np.int64,
    "tree_weights": float,
}
CODED = [StructField("positive", BinaryType()), StructField("draw", BinaryType()), StructField("margin", BinaryType()), StructField("codes", BinaryType())]
KINDS = {"positive": np.bool_, "draw": np.int64, "margin": np.float64, "codes": np.uint8}


class Coded(NamedTuple):
    """Rows in chunks of about CHUNK_ROWS: CODED and the columns by which chunks were kept apart, which can be filtered by."""

    layout: Layout
    chunks: DataFrame

    def filter(self, condition: Column) -> Coded:
        return Coded(self.layout, self.chunks.filter(condition))


def _chunks(part: pa.RecordBatch, layout: Layout) -> Iterator[list[np.ndarray]]:
    for i in range(part.num_rows):
        positive, draw, margin, codes = (np.frombuffer(part.column(c)[i].as_buffer(), kind) for c, kind in KINDS.items())
        yield [positive, draw, margin, codes.reshape(-1, layout.width)]


def _record(chunk: Sequence[np.ndarray], key: Sequence = (), groups: Sequence[StructField] = ()) -> pa.RecordBatch:
    blobs = {c: pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for (c, kind), v in zip(KINDS.items(), chunk)}
    return pa.RecordBatch.from_pydict({g.name: pa.array([k], to_arrow_type(g.dataType)) for g, k in zip(groups, key)} | blobs)


def coded(labelled: DataFrame, layout: Layout, before: Forest | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Chunks of coded rows; ``margin`` is that of the trees in ``before``. ``labelled`` has ``features`` and ``label``.

    Rows with different values in ``groups`` are in different chunks.
    """
    kept = [labelled.schema[g] for g in groups]

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for part in parts:
            if not part.num_rows:
                continue
            label = part.column("label").to_numpy(zero_copy_only=False)
            if not np.isin(label, (0.0, 1.0)).all():
                raise ValueError("labels have to be 0 or 1")
            x = _predictors(part.column("__x"))
            margin = before.margins(x, [before.trees])[:, 0] if before is not None else np.zeros(len(x))
            rows = [label == 1, part.column("draw").to_numpy(), margin, layout.codes(x)]
            keys = list(zip(*(part.column(g).to_pylist() for g in groups))) if groups else []
            names = {key: i for i, key in enumerate(dict.fromkeys(keys))} or {(): 0}
            which = np.array([names[key] for key in keys]) if keys else np.zeros(len(x), int)
            for key, i in names.items():
                mine = which == i
                held.setdefault(key, []).append([r[mine] for r in rows])
                if sum(len(r[0]) for r in held[key]) >= CHUNK_ROWS:
                    yield _record([np.concatenate(c) for c in zip(*held.pop(key))], key, kept)
        for key, rest in held.items():
            yield _record([np.concatenate(c) for c in zip(*rest)], key, kept)

    x = vector_to_array("features")
    known = ["id"] if "id" in labelled.columns else []
    draw, label = F.xxhash64("label", x, *known).alias("draw"), F.col("label").cast("double").alias("label")
    return labelled.select(draw, label, x.alias("__x"), *groups).mapInArrow(code, StructType([*kept, *CODED]))


def _stage_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks staged, and read a few at a time."""
    staged = stage(chunks, "coded")
    few = session_beside(staged.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(CHUNKS_AT_ONCE)})
    return few.read.schema(staged.schema).parquet(staged.inputFiles()[0].rsplit("/", 1)[0]).select(*staged.columns)


def coded_once(labelled: DataFrame, groups: Sequence[str]) -> Coded:
    """Codes of a long table for several fits, each of which filters by ``groups``."""
    layout = layout_of(labelled)
    return Coded(layout, _stage_chunks(coded(labelled, layout, groups=groups)))


def fit_in_task(labelled: DataFrame, params: dict) -> Forest:
    """A fit of up to ROWS_IN_TASK rows; ``labelled`` has ``features``, ``label`` and ``weight``, ``params`` the fields of ``TreeParams``."""
    layout = layout_of(labelled)

    def fit_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [chunk for part in parts for chunk in _chunks(part, layout)]
        if chunks:
            positive, draw, _, codes = (np.concatenate(c) for c in zip(*chunks))
            del chunks
            trees = grow_all(layout, codes, positive, draw, params)
            made = joined([t.forest(layout, step_of(params, i)) for i, t in enumerate(trees)])
            yield pa.RecordBatch.from_pydict({c: pa.array([getattr(made, c).astype(t).tobytes()], pa.binary()) for c, t in ARRAYS.items()})

    schema = StructType([StructField(c, BinaryType()) for c in ARRAYS])
    row = coded(labelled, layout).repartition(1).mapInArrow(fit_rows, schema).first()
    return Forest(**{c: np.frombuffer(row[c], t) for c, t in ARRAYS.items()})


def _count_pass(rows: DataFrame, layout: Layout, params: dict, number: int, tree: Tree, wanted: np.ndarray) -> list[np.ndarray]:
    """Histograms of the rows in ``wanted`` nodes of ``tree``, in one pass."""
    n_sums = 2 if params["positive_weight"] == 1 else 3
    place = np.full(len(tree.left), -1)
    place[wanted] = np.arange(len(wanted))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for chunk in (chunk for part in parts for chunk in _chunks(part, layout)):
            if params["row_share"] < 1:
                mine = is_drawn(chunk[1], number, params)
                chunk = [c[mine] for c in chunk]
            of_rows = place[tree.leaf(layout, chunk[3])]
            use = np.flatnonzero(of_rows >= 0)
            positive, _, margin, codes = (c[use] for c in chunk)
            value = residuals(positive, margin, number) * np.where(positive, params["positive_weight"], 1.0)
            found = histograms(layout, codes, of_rows[use], len(wanted), positive if n_sums == 3 else None, value)
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([np.stack(total).tobytes()], pa.binary())})

    out = np.zeros((n_sums, len(wanted), layout.width, BINS))
    for r in rows.mapInArrow(count, StructType([StructField("sums", BinaryType())])).collect():  # one per task
        out += np.frombuffer(r["sums"]).reshape(out.shape)
    return list(out)


def _cut(tree: Tree, params: dict) -> Tree:
    """The tree with its limit on leaves and its least gain applied."""
    plain = Forest(tree.split, np.zeros(len(tree.left)), tree.left, tree.right, tree.value, tree.gain, np.zeros(1, np.int64), np.ones(1))
    small, out = pruned(plain, params["leaves"], params["gamma"]), Tree()
    out.split, out.left, out.right, out.value, out.gain = small.feature, small.left, small.right, small.value, small.gain
    return out


def _add_tree(rows: DataFrame, layout: Layout, tree: Tree, step: float) -> DataFrame:
    """The same rows with the margins that they have after one more tree."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for positive, draw, margin, codes in (chunk for part in parts for chunk in _chunks(part, layout)):
            yield _record([positive, draw, margin + tree.value[tree.leaf(layout, codes)] * step, codes])

    return rows.select(*KINDS).mapInArrow(add, StructType(CODED))


def fit_in_passes(rows: DataFrame | Coded, params: dict, before: Forest | None = None) -> Forest:
    """``params["trees"]`` more trees behind ``before`` (the result has the new ones only), for tables of any length.

    ``leaves`` and ``gamma``, the latter as a weighted sum of squares, are applied to each tree as it is done.
    """
    own = []  # staged by this fit
    if isinstance(rows, Coded):
        layout, state = rows
    else:
        layout = layout_of(rows)
        state = _stage_chunks(coded(rows, layout, before))
        own.append(state)
    first, made = before.trees if before is not None else 0, []
    for number in range(first, first + params["trees"]):
        if made:
            state = _stage_chunks(_add_tree(state, layout, tree, step_of(params, number - 1)))
            discard(*own)
            own = [state]
        tree = _cut(grow(partial(_count_pass, state, layout, params, number), layout, params, number), params)
        made.append(tree.forest(layout, step_of(params, number)))
    discard(*own)
    return joined(made)
