"""Trees on binned rows against those of Spark ML, in one task and in passes."""

from dataclasses import asdict, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.models import boosting, forest, histograms, rounds, selection
from offerloom.models.boosting import TreeParams
from offerloom.operators.combine import TARGET

PLAIN = TreeParams(trees=5, step=0.3, depth=4, positive_weight=3.0, min_rows=2)
FEATURES = ["a", "b", "c", "d1", "d2", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers of many and few values, gaps, two dummies that never meet and a predictor with one value only."""
    raw = spark.range(1500).select(
        "id",
        (F.col("id") % 7).alias("a"),
        (F.hash("id") % 500).alias("b"),
        F.when(F.col("id") % 5 != 0, F.abs(F.hash("id", F.lit(1))) % 100).alias("c"),
        (F.col("id") % 11 == 1).cast("int").alias("d1"),
        (F.col("id") % 11 > 7).cast("int").alias("d2"),
        F.lit(4).alias("same"),
    )
    noise = F.abs(F.hash("id", F.lit(2))) % 10 == 0
    labelled = raw.withColumn(TARGET, (((F.col("a") > 3) & (F.col("b") > 5) | (F.col("d2") == 1)) != noise).cast("int"))
    return boosting.assemble(labelled, FEATURES, ["id", TARGET]).repartition(3, "id").cache()


def apart(rows, one, other):
    both = forest.add_margin(other, forest.add_margin(one, rows, "one"), "other")
    return both.agg(F.max(F.abs(F.col("one") - F.col("other")))).first()[0]


def test_trees_are_those_of_spark(spark, rows):
    whole = forest.of_model(spark, boosting.classifier(PLAIN).fit(boosting.with_label(rows, PLAIN)))
    labelled = boosting.with_label(rows, PLAIN)
    for fit in (histograms.fit_in_task, histograms.fit_in_passes):
        made = fit(labelled, asdict(PLAIN))
        assert made.trees == 5 and apart(rows, whole, made) < 1e-9
        assert made.leaves() == whole.leaves()
        assert np.allclose(forest.gain_importances(made, 6).sum(), 1.0)
        assert sorted(made.gain[made.gain > 0]) == pytest.approx(sorted(whole.gain[whole.gain > 0]))


def test_dummies_that_never_meet_share_a_column(rows):
    layout = histograms.layout_of(boosting.with_label(rows, PLAIN))
    assert layout.wide == [0, 1, 2] and layout.groups == [[3, 4]] and layout.width == 4
    codes = layout.codes(np.array([[0, -400.0, 3, 1, 0, 4], [6, 400.0, -1, 0, 1, 4], [6, 400.0, -1, 0, 0, 4]]))
    assert codes[:, 3].tolist() == [1, 2, 0] and codes[1:, 0].tolist() == [6, 6]


def test_long_columns_get_borders_by_weight():
    values = np.arange(100_000.0)
    found, total = histograms._summary(values, np.ones(100_000))
    assert len(found) <= histograms.VALUES and total.sum() == 100_000
    borders = histograms.borders_of(found, total)
    assert len(borders) == 31 and np.abs(borders - np.arange(1, 32) * 3125).max() < 60


def test_sampled_fits_are_the_same_again(rows):
    params = asdict(replace(PLAIN, row_share=0.8, feature_share=0.7))
    once = histograms.fit_in_task(boosting.with_label(rows, PLAIN), params)
    again = histograms.fit_in_task(boosting.with_label(rows.repartition(5), PLAIN), params)
    passes = histograms.fit_in_passes(boosting.with_label(rows, PLAIN), params)
    assert once.rows() == again.rows()
    assert once.leaves() == passes.leaves() and apart(rows, once, passes) < 1e-9
    other = histograms.fit_in_task(boosting.with_label(rows, PLAIN), params | {"seed": 1})
    assert other.rows() != once.rows()


def test_draws_have_the_stated_share():
    draw = np.arange(-50_000, 50_000, dtype=np.int64)
    shares = [histograms.is_drawn(draw, n, {"row_share": 0.9, "seed": 26}) for n in range(3)]
    assert all(abs(s.mean() - 0.9) < 0.01 for s in shares) and abs((shares[0] & shares[1]).mean() - 0.81) < 0.01


def test_long_tables_are_fitted_in_passes(rows, tmp_path, monkeypatch):
    few = replace(PLAIN, trees=3)
    by_spark = boosting.flat(boosting.fit(rows, few), rows)
    blocks = rounds.fit_rounds(rows, replace(few, depth=6, leaves=6, gamma=0.2), every=2, store=str(tmp_path / "a")).forest
    monkeypatch.setattr(histograms, "ROWS_IN_TASK", 1000)
    monkeypatch.setattr(histograms, "CHUNK_ROWS", 100)
    monkeypatch.setattr(boosting, "classifier", None)
    assert apart(rows, by_spark, boosting.fit(rows, few)) < 1e-9
    again = rounds.fit_rounds(rows, replace(few, depth=6, leaves=6, gamma=0.2), every=2, store=str(tmp_path / "b")).forest
    assert again.leaves() == blocks.leaves() and max(again.leaves()) <= 6 and apart(rows, blocks, again) < 1e-9


def test_folds_of_long_tables_share_their_codes(rows, monkeypatch):
    params = replace(PLAIN, trees=2, depth=3)
    grid = {"step": [0.1, 0.3], "trees": [1, 2]}

    def found():
        folded = selection.into_folds(rows, 3)
        scores = selection.held_out_scores(folded, selection.fit_folds(folded, params, 3, every=1))
        points = selection.cv_tree_count(rows, params, 3).table.collect() + selection.grid_search(rows, params, grid, n_folds=3).collect()
        return {r.id: r.score for r in scores.collect()}, points

    by_spark, points = found()
    monkeypatch.setattr(histograms, "ROWS_IN_TASK", 400)
    monkeypatch.setattr(boosting, "classifier", None)
    made, again = found()
    assert made.keys() == by_spark.keys() and len(made) == 1500
    # borders of bins are those of all folds here, so a few rows beside a border fall to the other side
    assert np.mean([abs(made[i] - by_spark[i]) < 0.1 for i in made]) > 0.95
    assert [p.n_folds for p in again[:2]] == [3, 3] and len(again) == len(points) == 6
    assert [p.auc_mean for p in again[:2]] == pytest.approx([p.auc_mean for p in points[:2]], abs=0.02)


def test_chunks_are_handed_over_a_few_at_a_time(spark, rows, monkeypatch):
    monkeypatch.setattr(histograms, "CHUNK_ROWS", 20)
    labelled = boosting.with_label(rows, PLAIN).withColumn("side", F.col("id") % 2)
    coded = histograms.coded_once(labelled.coalesce(1), ["side"])
    batches = coded.filter(F.col("side") == 1).chunks.mapInArrow(lambda parts: (p.select(["side"]) for p in parts), "side bigint")
    assert {r.side for r in batches.collect()} == {1}
    sizes = coded.chunks.mapInArrow(lambda parts: (p.slice(0, 1).select(["side"]) for p in parts), "side bigint").count()
    assert coded.chunks.count() >= 2 and sizes >= coded.chunks.count() / histograms.CHUNKS_AT_ONCE
    rows_held = sum(len(r.positive) for r in coded.chunks.collect())
    assert rows_held == 1500 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_many_trees_take_no_job_per_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "classifier", None)
    params = replace(PLAIN, trees=40, step=0.1)
    made = boosting.fit(rows, params)
    assert made.trees == 40 and made.first(5).trees == 5
    exact = forest.exact_aucs(made, rows, [1, 7, 40], TARGET)
    assert forest.task_aucs(made, rows, range(1, 41), TARGET).items() >= exact.items()
    assert forest.task_aucs(made, rows.where(f"{TARGET} = 1"), [1, 2], TARGET) == {}
    top = boosting.importances(made, FEATURES, rows).orderBy(F.desc("importance")).first()
    assert top.feature in ("a", "d2")
    history = selection.cv_tree_count(rows, params, 3, patience=5)
    points = history.table.collect()
    assert [p.n_trees for p in points] == list(range(1, 41)) and {p.auc_slack for p in points} == {0.0}


def test_a_class_other_than_0_and_1_stops_the_fit(rows):
    odd = rows.withColumn(TARGET, F.when(F.col("id") != 7, F.col(TARGET)))
    with pytest.raises(Exception, match="labels have to be 0 or 1"):
        boosting.fit(odd, replace(PLAIN, trees=20))
