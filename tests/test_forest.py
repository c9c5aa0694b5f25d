"""Flat trees, pruning, AUC bounds, and fits in blocks against plain computations."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from offerloom.models import boosting, forest, rounds, selection
from offerloom.models.boosting import TreeParams
from offerloom.models.forest import Forest
from offerloom.models.selection import Judged
from offerloom.operators.combine import TARGET

PLAIN = TreeParams(trees=6, step=0.3, depth=3, positive_weight=2.0)


@pytest.fixture(scope="module")
def rows(spark):
    """Rows whose label follows from two predictors with some noise."""
    raw = spark.range(1500).select(
        "id",
        (F.col("id") % 7).alias("a"),
        (F.hash("id") % 50).alias("b"),
        F.when(F.col("id") % 5 != 0, F.abs(F.hash("id", F.lit(1))) % 100).alias("c"),
    )
    noise = F.abs(F.hash("id", F.lit(2))) % 10 == 0
    labelled = raw.withColumn(TARGET, (((F.col("a") > 3) & (F.col("b") > 5)) != noise).cast("int"))
    return boosting.assemble(labelled, ["a", "b", "c"], ["id", TARGET]).repartition(3, "id").cache()


def plain_margin(model, x, trees):
    """Walk one row through the nodes of a forest, one tree after the other."""
    total = 0.0
    for root, weight in zip(model.roots[:trees], model.tree_weights):
        node = root
        while model.left[node] != node:
            node = model.left[node] if x[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node] * weight
    return total


def plain_auc(y, score):
    pairs = [(p, n) for p, a in zip(score, y) if a for n, b in zip(score, y) if not b]
    return sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs)


def test_margins_equal_the_model_and_a_plain_walk(spark, rows):
    model = boosting.fit(rows, PLAIN)
    flat = forest.of_model(spark, model)
    assert flat.trees == 6 and flat.depth() == 3
    raw = vector_to_array("rawPrediction")[1].alias("raw")  # Spark's raw prediction is twice... or once the margin
    scored = model.transform(forest.add_margin(flat, rows)).select("margin", raw, vector_to_array("features").alias("x"))
    got = scored.collect()
    assert all(abs(r.margin - r.raw) < 1e-12 for r in got)
    assert all(abs(r.margin - plain_margin(flat, r.x, 6)) < 1e-12 for r in got[:200])
    long = forest.long_margins(flat, rows.limit(50), [2, 5, 0]).join(rows.select("id", "features"), "id").collect()
    assert len(long) == 150
    assert all(abs(r.margin - plain_margin(flat, r.features.toArray(), r.n_trees)) < 1e-12 for r in long)
    again = forest.of_rows(random.Random(1).sample(flat.rows(), len(flat.value)))
    assert again.rows() == flat.rows() and flat.first(4).rows() == [r for r in flat.rows() if r[0] < 4]


def test_plan_does_not_grow_with_trees(rows):
    one = Forest(*(np.array(v) for v in ([0, 0, 0], [3.0, 0, 0], [1, 1, 2], [2, 1, 2], [0, -1.0, 1.0], [5.0, 0, 0], [0], [1.0])))

    def nodes(trees):
        plan = forest.add_margin(forest.joined([one] * trees), rows)._jdf.queryExecution().optimizedPlan()
        return len(plan.toString().splitlines())

    assert nodes(20) == nodes(200)
    assert forest.joined([one] * 200).margins(np.array([[1.0], [4.0]]), [200, 7]).tolist() == [[-200, -7], [200, 7]]


def random_tree(drawn, nodes):
    """A tree of ``nodes`` splits in the order parents before children."""
    left, right, gain, open_ = [], [], [], [0]
    left, right, gain = [0], [0], [0.0]
    for _ in range(nodes):
        node = open_.pop(drawn.randrange(len(open_)))
        for side in (left, right):
            side[node] = len(left)
            open_.append(len(left))
            left.append(len(left)), right.append(len(right)), gain.append(0.0)
        gain[node] = drawn.choice([0.5, 1.0, 2.0, drawn.random() * 10])
    count = len(left)
    return Forest(
        np.array([drawn.randrange(3) for _ in range(count)]), np.array([drawn.random() for _ in range(count)]),
        np.array(left), np.array(right), np.array([drawn.random() for _ in range(count)]), np.array(gain),
        np.array([0]), np.array([1.0]),
    )


def plain_best_first(tree, max_leaves):
    """Set of inner nodes after always splitting the leaf with the largest gain."""
    leaves, kept = [0], set()
    while len(leaves) < max_leaves:
        splittable = [n for n in leaves if tree.left[n] != n]
        if not splittable:
            break
        node = min(splittable, key=lambda n: (-tree.gain[n], n))
        leaves.remove(node)
        leaves += [tree.left[node], tree.right[node]]
        kept.add(node)
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_best_first_pruning_equals_growth(seed):
    drawn = random.Random(seed)
    tree = random_tree(drawn, 60)
    for most in (1, 2, 7, 31, 100):
        small = forest.pruned(tree, most)
        kept = plain_best_first(tree, most)
        assert small.leaves()[0] == len(kept) + 1 <= most
        assert sorted(small.gain[small.inner()]) == sorted(tree.gain[list(kept)])
        cut = replace(tree, left=tree.left.copy(), right=tree.right.copy())
        for node in set(range(len(tree.left))) - kept:
            cut.left[node] = cut.right[node] = node
        for _ in range(50):
            x = [drawn.random() for _ in range(3)]
            assert plain_margin(small, x, 1) == plain_margin(cut, x, 1) == small.margins(np.array([x]), [1])[0, 0]


def test_splits_under_the_least_gain_are_taken_back():
    tree = random_tree(random.Random(9), 60)
    small = forest.pruned(tree, None, 2.0)
    inner = small.inner()
    for node in np.flatnonzero(inner):
        both_leaves = not inner[small.left[node]] and not inner[small.right[node]]
        assert small.gain[node] >= 2.0 or not both_leaves
    assert (small.gain[inner] < 2.0).any() and small.leaves()[0] < tree.leaves()[0]
    assert forest.pruned(tree, None, 0.0).rows() == tree.rows()
    assert forest.pruned(tree, None, 100.0).leaves() == [1]


def test_gain_of_a_split_is_what_it_takes_off_the_squares(spark, rows):
    flat = forest.of_model(spark, boosting.fit(rows, replace(PLAIN, trees=1, depth=1)))
    data = [(r.features.toArray(), 2 * r[TARGET] - 1, 2.0 if r[TARGET] else 1.0) for r in rows.collect()]

    def squares(part):
        w, wy = sum(p[2] for p in part), sum(p[1] * p[2] for p in part)
        return sum(p[2] * p[1] ** 2 for p in part) - wy**2 / w

    left = [d for d in data if d[0][flat.feature[0]] <= flat.threshold[0]]
    right = [d for d in data if d[0][flat.feature[0]] > flat.threshold[0]]
    assert flat.gain[0] == pytest.approx(squares(data) - squares(left) - squares(right))


@pytest.mark.parametrize("buckets, sample", [(1024, 4096), (8, 100), (1, 5)])
def test_bounds_hold_the_exact_auc(spark, rows, buckets, sample):
    flat = forest.of_model(spark, boosting.fit(rows, PLAIN))
    data = rows.collect()
    x, y = np.array([r.features.toArray() for r in data]), [r[TARGET] for r in data]
    bounds = forest.auc_bounds(flat, rows, [1, 3, 6], TARGET, buckets, sample)
    exact = forest.exact_aucs(flat, rows, [1, 3, 6], TARGET)
    for n, scores in zip([1, 3, 6], flat.margins(x, [1, 3, 6]).T):
        scores = np.round(scores, 12)  # rows of one leaf: the order of adding must not part them
        assert bounds[n][0] - 1e-9 <= exact[n] <= bounds[n][1] + 1e-9
        assert exact[n] == pytest.approx(plain_auc(y, scores), abs=1e-4)
    if sample >= len(data):
        assert bounds[1][0] == bounds[1][1]  # a border for every margin that occurs: only ties are left
    assert forest.auc_bounds(flat, rows.where(F.col(TARGET) == 1), [1], TARGET) == {}


def test_contested_counts_are_enough_for_the_choice():
    drawn = random.Random(3)
    for _ in range(300):
        exact = [drawn.randint(0, 30) / 30 for _ in range(20)]
        bounds = {n: (v - drawn.choice([0, 0.02, 0.1]), v + drawn.choice([0, 0.02, 0.1])) for n, v in enumerate(exact, 1)}
        open_ = selection.contested(bounds)
        values = [(n, exact[n - 1] if n in open_ or low == high else (low + high) / 2) for n, (low, high) in bounds.items()]
        for patience in (1, 4, 20):
            assert selection.best_by_patience(values, patience) == selection.best_by_patience(list(enumerate(exact, 1)), patience)


def test_blocks_give_the_trees_of_one_fit(spark, rows, tmp_path):
    whole = forest.of_model(spark, boosting.fit(rows, PLAIN))
    parts = rounds.fit_rounds(rows, PLAIN, every=2, store=str(tmp_path))
    assert parts.forest.trees == parts.best_trees == parts.fitted_now == 6 and not parts.stopped
    x = np.array([r.features.toArray() for r in rows.collect()])
    assert np.abs(whole.margins(x, range(7)) - parts.forest.margins(x, range(7))).max() < 1e-9


def test_patience_ends_the_fit_with_the_choice_of_the_full_history(spark, rows, tmp_path):
    params = replace(PLAIN, trees=14, step=0.9, depth=5)
    fit_on, judge_on = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    full = rounds.fit_rounds(fit_on, params, judge_on, None, every=2, store=str(tmp_path))
    short = rounds.fit_rounds(fit_on, params, judge_on, 3, every=2, store=str(tmp_path / "other"))
    assert short.best_trees == selection.best_by_patience([p[:2] for p in full.points], 3)
    assert short.stopped and short.forest.trees < full.forest.trees == 14
    assert short.points == full.points[: len(short.points)]
    table = rounds.history_table(spark, short).collect()
    assert [r.n_trees for r in table if r.chosen] == [short.best_trees] and all(r.stopped for r in table)


def test_a_fit_goes_on_behind_its_finished_blocks(rows, tmp_path):
    params, judge_on = replace(PLAIN, feature_share=0.7, row_share=0.8), rows.where("id % 3 = 0")
    at_once = rounds.fit_rounds(rows, params, judge_on, 100, every=2, store=str(tmp_path / "a"))
    store = str(tmp_path / "b")
    first = rounds.fit_rounds(rows, params, judge_on, 100, every=2, store=store, most_blocks=1)
    assert first.forest.trees == first.fitted_now == 2 and not first.stopped
    half = next((tmp_path / "b").iterdir()) / "trees-000002" / "nodes"
    half.mkdir(parents=True)  # a block that a lost driver has left unfinished
    rest = rounds.fit_rounds(rows, params, judge_on, 100, every=2, store=store)
    assert rest.fitted_now == 4 and rest.forest.rows() == at_once.forest.rows() and rest.points == at_once.points
    again = rounds.fit_rounds(rows, params, judge_on, 100, every=2, store=store)
    assert again.fitted_now == 0 and again.forest.rows() == at_once.forest.rows()
    other = rounds.fit_rounds(rows.where("id > 3"), params, judge_on, 100, every=2, store=store, most_blocks=1)
    assert other.fitted_now == 2  # other rows: nothing is taken over


def test_folds_go_on_after_a_lost_driver(rows, tmp_path):
    folded = selection.into_folds(rows, 4)
    params, store = replace(PLAIN, trees=2), str(tmp_path / "folds")
    before = rounds.fit_fold_rounds(folded, params, 4, every=2, store=store, folds=[0, 1])
    after = rounds.fit_fold_rounds(selection.into_folds(rows, 4), params, 4, every=2, store=store)
    assert [f.fit.fitted_now for f in after] == [0, 0, 2, 2]
    assert [f.fit.forest.rows() for f in after[:2]] == [f.fit.forest.rows() for f in before]
    fresh = rounds.fit_fold_rounds(folded, params, 4, every=2, store=str(tmp_path / "fresh"))
    assert [f.fit.points for f in fresh] == [f.fit.points for f in after]


def test_cross_validation_stops_all_folds_together(rows, tmp_path):
    params = replace(PLAIN, trees=12, step=0.9, depth=5)
    history = rounds.cv_rounds(rows, params, 2, patience=3, every=2, store=str(tmp_path))
    points = {r.n_trees: r for r in history.table.collect()}
    assert max(points) < 12 and set(points) == set(range(1, max(points) + 1))
    assert all(r.n_folds == 2 for r in points.values())
    whole = selection.cv_tree_count(rows, params, 2, patience=3)
    assert whole.best_trees == history.best_trees
    for r in whole.table.collect():
        if r.n_trees in points:
            assert abs(r.auc_mean - points[r.n_trees].auc_mean) <= r.auc_slack + points[r.n_trees].auc_slack + 1e-3


def test_leaf_limit_and_gain_threshold_in_a_fit(rows, tmp_path):
    limited = rounds.fit_rounds(rows, replace(PLAIN, trees=3, depth=8, leaves=6), every=3, store=str(tmp_path)).forest
    assert max(limited.leaves()) <= 6 and limited.depth() > 3  # 2^3 leaves would have been a cap on depth
    grown = rounds.fit_rounds(rows, replace(PLAIN, trees=3, depth=8), every=3, store=str(tmp_path)).forest
    strict = rounds.fit_rounds(rows, replace(PLAIN, trees=3, depth=8, gamma=0.5), every=3, store=str(tmp_path)).forest
    assert sum(strict.leaves()) < sum(grown.leaves())
    first = forest.pruned(grown.first(1), 6)
    assert first.rows() == limited.first(1).rows()
