"""Queries over fitted models do their whole job: all trees, the full depth and ten folds."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.models import boosting, forest
from offerloom.models.boosting import PARAMS_A, PARAMS_B
from offerloom.models.forest import Forest
from offerloom.operators.combine import TARGET
from offerloom.plans import catalog
from offerloom.plans.modelling import ModelTable

ONE = Forest(*(np.array(v) for v in ([0, 0, 0], [3.0, 0, 0], [1, 1, 2], [2, 1, 2], [0, -0.1, 0.1], [5.0, 0, 0], [0], [1.0])))


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5 < 2).cast("int").alias(TARGET))
    made = boosting.assemble(rows, ["a"], ["id", TARGET]).cache()
    return ModelTable(made.where("id < 300"), made.where("id >= 300"), ["a"])


@pytest.fixture
def fitted(monkeypatch):
    """Parameters of all fits; what they give are that many trees of one split."""
    seen = []

    def fit(rows, params, target=TARGET):
        seen.append(params)
        return forest.joined([ONE] * params.trees)

    monkeypatch.setattr(boosting, "fit", fit)
    return seen


def test_cv_tree_count_goes_through_all_trees(table, fitted):
    found = catalog.q_cv_tree_count(table).collect()
    assert [r.n_trees for r in found] == list(range(1, 1001)) and {r.n_folds for r in found} == {10}
    assert fitted == [PARAMS_A] * 10


def test_fold_auc_has_ten_folds(table, fitted):
    assert sorted(r.fold for r in catalog.q_fold_auc(table).collect()) == list(range(10))
    assert fitted == [PARAMS_B] * 10


def test_scores_of_model_a(table, fitted):
    assert catalog.q_gbt_scores_a(table).count() == 100 and fitted == [PARAMS_A]


def test_scores_of_model_b(table, fitted):
    assert catalog.q_gbt_scores_b(table).count() == 100 and fitted == [PARAMS_B]


def test_holdout_auc_is_that_of_all_trees(table, fitted):
    assert catalog.q_holdout_auc(table).count() == 1 and fitted == [PARAMS_A]


def test_held_out_scores_come_from_ten_folds(table, fitted):
    found = catalog.q_oof_scores(table).collect()
    assert len({r.id for r in found}) == len(found) == 300 and {r.fold for r in found} == set(range(10))
    assert fitted == [PARAMS_B] * 10


def test_blended_scores_come_from_whole_models(table, fitted):
    assert catalog.q_score_corr(table).count() == 4
    assert fitted[:10] == [PARAMS_A] * 10 and fitted[11:] == [PARAMS_B] * 10
    assert replace(fitted[10], trees=1000) == PARAMS_A


def test_top_features_are_those_of_all_trees(table, fitted):
    assert catalog.q_top_features(table).first().feature == "a" and fitted == [PARAMS_A]


def test_train_and_holdout_auc_are_those_of_all_trees(table, fitted):
    assert {r.source for r in catalog.q_train_holdout_auc(table).collect()} == {"train", "holdout"}
    assert fitted == [PARAMS_A]
