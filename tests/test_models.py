from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from offerloom.models import boosting, selection
from offerloom.models.boosting import PARAMS_A, PARAMS_B
from offerloom.operators.combine import TARGET
from offerloom.plans import modelling
from offerloom.plans.modelling import ModelTable

SMALL_A = replace(PARAMS_A, trees=4, depth=3)
SMALL_B = replace(PARAMS_B, trees=4, depth=3, step=0.3)


@pytest.fixture(scope="module")
def table(spark):
    """Rows whose label follows from two predictors, a third is noise."""
    rows = spark.range(1200).select(
        "id",
        (F.col("id") % 7).alias("a"),
        (F.col("id") % 11).alias("b"),
        F.when(F.col("id") % 5 != 0, F.hash("id") % 100).alias("noise"),
    )
    labelled = rows.withColumn(TARGET, ((F.col("a") > 4) & (F.col("b") > 4)).cast("int"))
    features = ["a", "b", "noise"]
    assembled = boosting.assemble(labelled, features, ["id", TARGET]).cache()
    return ModelTable(
        assembled.filter("id < 1000"), assembled.filter("id >= 1000").drop(TARGET), features
    )


def test_holdout_report_sees_the_signal(table):
    report = modelling.holdout_report(table, SMALL_A)
    assert report.auc.first().auc > 0.95
    cells = {(r.label, r.prediction): r.n for r in report.confusion.collect()}
    assert sum(cells.values()) == report.scores.count() and cells[1, 1] > 0
    top = [r.feature for r in modelling.top_features(report.model, table, 2).collect()]
    assert set(top) == {"a", "b"}


def test_auc_on_seen_and_unseen_rows(table):
    found = {r.source: r.auc for r in modelling.train_and_holdout_auc(table, SMALL_A).collect()}
    assert set(found) == {"train", "holdout"} and found["train"] > 0.95
    assert found["holdout"] == modelling.holdout_report(table, SMALL_A).auc.first().auc


def test_first_trees_of_a_model_are_the_smaller_model(table):
    # Rows and predictors are sampled for each tree; the seed makes the samples the same.
    params = replace(SMALL_B, row_share=0.8)
    four, two = boosting.fit(table.train, params), boosting.fit(table.train, replace(params, trees=2))
    for n, model in ((4, four), (2, two)):
        full = boosting.add_score(model, table.test, "full")
        both = boosting.add_score(four, full, "first", n)
        assert both.filter(F.abs(F.col("full") - F.col("first")) > 1e-12).isEmpty()
    margins = boosting.staged_margins(four, table.test, [1, 2, 4])
    assert margins.count() == 3 * table.test.count()


def test_patience():
    assert selection.best_by_patience([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.65), (5, 0.9)], 2) == 2
    assert selection.best_by_patience([(1, 0.5), (2, 0.7), (3, 0.6), (4, 0.65), (5, 0.9)], 3) == 5
    assert selection.tree_counts(replace(PARAMS_A, trees=25), 10) == [10, 20, 25]


def test_cross_validated_tree_count(table):
    history = selection.cv_tree_count(table.train, SMALL_B, n_folds=3)
    points = {r.n_trees: r for r in history.table.collect()}
    assert set(points) == {1, 2, 3, 4} and all(r.n_folds == 3 for r in points.values())
    assert points[history.best_trees].auc_mean == max(r.auc_mean for r in points.values())
    assert selection.cv_auc(table.train, replace(SMALL_B, trees=2), n_folds=2) > 0.9


def test_every_row_is_held_out_once_and_scores_are_averaged(table):
    mixed = modelling.blended_scores(table, SMALL_A, SMALL_B, n_folds=3, every=2)
    assert mixed.held_out.count() == mixed.held_out.select("id").distinct().count() == table.train.count()
    folds = modelling.fold_auc(mixed.held_out).collect()
    assert len(folds) == 3 and all(r.auc > 0.9 for r in folds)
    scores = mixed.scores.cache()
    assert scores.count() == table.test.count()
    assert scores.filter(F.abs(F.col("score") - (F.col("score_a") + F.col("score_b")) / 2) > 1e-12).isEmpty()
    # Scoring by all models is one map over the rows.
    assert "Exchange" not in mixed.scores._jdf.queryExecution().sparkPlan().toString()
    template = table.test.select("id").unionByName(table.test.sparkSession.range(9999, 10000))
    sent = modelling.submission(template, scores, "score")
    assert sent.columns == ["id", TARGET] and sent.count() == table.test.count() + 1
    assert [r.id for r in sent.filter(F.col(TARGET).isNull()).collect()] == [9999]
    assert modelling.score_correlation(scores).count() == 4


def test_grid_search(table):
    grid = {"step": [0.1, 0.3], "depth": [1, 3]}
    assert len(selection.grid_points(grid)) == 4
    drawn = selection.grid_points(selection.DEFAULT_GRID, draws=5)
    assert len(drawn) == 5 and drawn == selection.grid_points(selection.DEFAULT_GRID, draws=5)
    grid["trees"] = [1, 2]
    found = selection.grid_search(table.train, SMALL_B, grid, n_folds=2).collect()
    assert len({(r.step, r.depth, r.trees) for r in found}) == 8
    assert [r.auc_mean for r in found] == sorted((r.auc_mean for r in found), reverse=True)
    by_point = {(r.step, r.depth, r.trees): r.auc_mean for r in found}
    assert by_point[0.3, 3, 1] > by_point[0.3, 1, 1]
    alone = selection.cv_auc(table.train, replace(SMALL_B, trees=2, step=0.3, depth=1), n_folds=2)
    assert alone == pytest.approx(by_point[0.3, 1, 2])
