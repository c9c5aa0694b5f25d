"""Boosting in blocks of trees: a fit that stops by patience, goes on after a lost driver, and prunes its trees.

A block starts from the staged margins of the trees before it. Every tree is a Spark ML regression tree on the
pseudo-residuals of the log loss, as in ``GBTClassifier``; without pruning and sampling the trees are the same.
After a block the judging rows are scored in one pass and their AUC after each of its trees is added to the
history. Fitting ends where ``patience`` trees have brought nothing better, so later trees are never fitted.

Blocks are stored as they are finished, in a folder named after a digest of the rows and of all parameters.
A fit finds the blocks that are there and goes on behind them: a lost driver costs one block, and a fit that was
finished is read and not run again. The first table of a block holds its trees, the second its AUCs; a block counts
once the second is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, replace
from functools import partial
from typing import NamedTuple

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.models import boosting, forest, histograms
from offerloom.models.boosting import TreeParams
from offerloom.models.forest import Forest
from offerloom.models.selection import POINTS, History, Judged, best_by_patience, into_folds, judge
from offerloom.operators.combine import TARGET
from offerloom.operators.splits import SEED, fold_rows, is_holdout
from offerloom.session import ensure_checkpoint_folder, shared_folder
from offerloom.sources.tables import discard, is_written, side_by_side, stage_for_fits

#: ``gamma`` is on the scale of half the squared sum of gradients over their rows, the loss reduction of a Newton step
#: with second derivatives of 1. Residuals are four times the gradient of the log loss, so the
#: weighted sum of squares that a split explains is 32 times that.
GAIN_SCALE = 32.0


class Fit(NamedTuple):
    """Trees that were fitted, the history of the judging rows, and how many trees are best."""

    forest: Forest
    points: list[tuple]
    best_trees: int
    stopped: bool
    #: Trees that this call has fitted; those of an earlier call were read.
    fitted_now: int


def rows_digest(rows: DataFrame, target: str = TARGET) -> str:
    """A digest of predictors and target of all rows, whatever their order."""
    row = F.xxhash64(F.col(target), vector_to_array("features"), *(["id"] if "id" in rows.columns else []))
    total = rows.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{total[0]}:{total[1]}".encode()).hexdigest()[:24]


def fit_key(digest: str, params: TreeParams, *more: object) -> str:
    return hashlib.sha256(repr((digest, replace(params, trees=0), *more)).encode()).hexdigest()[:24]


def ended(points: Sequence[tuple], patience: int | None) -> bool:
    """Whether ``patience`` trees have brought nothing better than the best before them."""
    if patience is None or not points:
        return False
    best = best_by_patience([p[:2] for p in points], patience)
    return points[-1][0] - best >= patience


def _one_tree(state: DataFrame, number: int, params: TreeParams) -> Forest:
    y, margin = F.col("y"), F.col("margin")
    residual = y if number == 0 else 4.0 * y / (1.0 + F.exp(2.0 * y * margin))
    regressor = RandomForestRegressor(
        labelCol="residual",
        featuresCol="features",
        weightCol="weight",
        numTrees=1,
        bootstrap=False,
        maxDepth=params.depth,
        subsamplingRate=params.row_share,
        featureSubsetStrategy="all" if params.feature_share == 1.0 else str(params.feature_share),
        minInstancesPerNode=params.min_rows,
        maxMemoryInMB=512,
        seed=params.seed + number,
    )
    model = regressor.fit(state.select("features", "weight", residual.alias("residual")))
    weight = 1.0 if number == 0 else params.step
    tree = forest.of_model(state.sparkSession, model, [weight])
    return forest.pruned(tree, params.leaves, params.gamma * GAIN_SCALE)


def fit_block(rows: DataFrame, before: Forest, params: TreeParams, trees: int, target: str = TARGET) -> Forest:
    """``trees`` more trees behind those of ``before``."""
    ensure_checkpoint_folder(rows.sparkSession)
    labelled = boosting.with_label(rows, params, target)
    if rows.count() > histograms.ROWS_IN_TASK:
        plain = asdict(replace(params, trees=trees, gamma=params.gamma * GAIN_SCALE))
        return histograms.fit_in_passes(labelled, plain, before)
    labelled = labelled.select("features", "weight", (2.0 * F.col("label") - 1.0).alias("y"))
    state = stage_for_fits(forest.add_margin(before, labelled), "margins")
    made: list[Forest] = []
    for number in range(before.trees, before.trees + trees):
        now = state
        if made:
            added = forest.add_margin(forest.joined(made), state, "added")
            now = added.withColumn("margin", F.col("margin") + F.col("added")).drop("added")
        made.append(_one_tree(now, number, params))
    discard(state)
    return forest.joined(made)


def _block_folder(folder: str, begin: int) -> str:
    return f"{folder}/trees-{begin:06d}"


def stored_blocks(spark: SparkSession, folder: str) -> tuple[Forest, list[tuple]]:
    """Trees and points of all finished blocks, in order."""
    parts, points, begin = [], [], 0
    while is_written(spark, f"{_block_folder(folder, begin)}/points"):
        path = _block_folder(folder, begin)
        parts.append(forest.of_rows([tuple(r) for r in spark.read.schema(forest.NODE).parquet(f"{path}/nodes").collect()]))
        points += sorted(tuple(r) for r in spark.read.schema(POINTS).parquet(f"{path}/points").collect())
        begin += parts[-1].trees
    return forest.joined(parts), points


def _store(spark: SparkSession, folder: str, begin: int, block: Forest, points: Sequence[tuple]) -> None:
    path = _block_folder(folder, begin)
    nodes = spark.createDataFrame(block.rows(), forest.NODE)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame(list(points), POINTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/points")


def fit_rounds(
    rows: DataFrame,
    params: TreeParams,
    judge_on: DataFrame | None = None,
    patience: int | None = 100,
    every: int = 10,
    target: str = TARGET,
    store: str | None = None,
    most_blocks: int | None = None,
) -> Fit:
    """Fit up to ``params.trees`` trees in blocks of ``every``; stop by the AUC of ``judge_on``.

    ``store`` is the folder that keeps the blocks (default: ``fits`` in the shared folder). ``most_blocks`` ends the
    call after so many blocks, as a lost driver would; the next call goes on.
    """
    spark = rows.sparkSession
    judged = "none" if judge_on is None else rows_digest(judge_on, target)
    key = fit_key(rows_digest(rows, target), params, judged, every)
    folder = f"{store or shared_folder(spark) + '/fits'}/{key}"
    done, points = stored_blocks(spark, folder)
    if done.trees > params.trees:  # blocks of a longer fit with otherwise the same parameters
        done, points = done.first(params.trees), [p for p in points if p[0] <= params.trees]
    blocks = fitted = 0
    while done.trees < params.trees and not ended(points, patience) and blocks != most_blocks:
        trees = min(every, params.trees - done.trees)
        block = fit_block(rows, done, params, trees, target)
        whole = forest.joined([done, block])
        new: list[tuple] = []
        if judge_on is not None:
            counts = range(done.trees + 1, whole.trees + 1)
            exact = forest.exact_aucs(whole, judge_on, list(counts), target)
            if not exact:
                raise ValueError("no rows of both classes to judge the trees on")
            new = [(n, exact[n], None, 0.0, 1) for n in counts]
        if trees == every:  # a shorter last block belongs to this number of trees only
            _store(spark, folder, done.trees, block, new)
        done, points, blocks, fitted = whole, points + new, blocks + 1, fitted + trees
    if not points:
        return Fit(done, [], done.trees, False, fitted)
    best = best_by_patience([p[:2] for p in points], patience if patience is not None else params.trees)
    return Fit(done, points, best, done.trees < params.trees and ended(points, patience), fitted)


def history_table(spark: SparkSession, fit: Fit) -> DataFrame:
    """n_trees, auc, whether it is the chosen number, and whether patience ended the fit."""
    rows = [(p[0], p[1], p[0] == fit.best_trees, fit.stopped) for p in fit.points]
    return spark.createDataFrame(rows, "n_trees int, auc double, chosen boolean, stopped boolean")


def cv_rounds(
    rows: DataFrame,
    params: TreeParams,
    n_folds: int = 10,
    patience: int = 100,
    every: int = 10,
    key: str = "id",
    seed: int = SEED,
    store: str | None = None,
    parallelism: int = 2,
) -> History:
    """Mean AUC over folds after every number of trees, all folds going on together until patience ends them.

    After each block of all folds the mean AUC of its counts is worked out in one pass per fold. Where
    nothing got better for ``patience`` trees, no fold fits another block.
    """
    spark = rows.sparkSession
    folded = into_folds(rows, n_folds, key, seed)
    parts = [fold_rows(folded, fold) for fold in range(n_folds)]
    points: list[tuple] = []
    begin = 0
    while begin < params.trees and not ended(points, patience):
        upto = replace(params, trees=min(begin + every, params.trees))
        jobs = [partial(fit_rounds, fit_on, upto, None, None, every, store=store) for fit_on, _ in parts]
        fits = side_by_side(spark, jobs, parallelism)
        judged = [Judged(fit.forest, score_on) for fit, (_, score_on) in zip(fits, parts)]
        # what was best before is judged again beside the new counts: bounds are resolved among all of them
        best = [best_by_patience([p[:2] for p in points], patience)] if points else []
        new = judge(judged, [*best, *range(begin + 1, upto.trees + 1)])
        points = [p for p in points if p[0] not in best] + new
        points.sort()
        begin = upto.trees
    table = spark.createDataFrame(points, POINTS)
    return History(table, best_by_patience([p[:2] for p in points], patience))


class FoldFit(NamedTuple):
    fold: int
    fit: Fit


def fit_fold_rounds(
    folded: DataFrame,
    params: TreeParams,
    n_folds: int = 10,
    patience: int = 100,
    every: int = 10,
    key: str = "id",
    seed: int = SEED,
    store: str | None = None,
    folds: Sequence[int] | None = None,
    parallelism: int = 2,
) -> list[FoldFit]:
    """One fit per fold, each stopped by rows that are neither fitted on nor in the fold; finished ones are read."""

    def fit_one(fold: int) -> FoldFit:
        others, _ = fold_rows(folded, fold)
        stopping = is_holdout(F.col(key), seed=seed)
        return FoldFit(
            fold, fit_rounds(others.filter(~stopping), params, others.filter(stopping), patience, every, store=store)
        )

    jobs = [partial(fit_one, fold) for fold in (range(n_folds) if folds is None else folds)]
    return side_by_side(folded.sparkSession, jobs, parallelism)
