"""From the encoded table to blended scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.numeric import blend, hard_class
from offerloom.models import boosting, selection
from offerloom.models.boosting import PARAMS_A, PARAMS_B, TreeParams
from offerloom.models.forest import Forest
from offerloom.operators.combine import TARGET, split_by_source, top_rows, union_tagged
from offerloom.operators.encode import label_encode
from offerloom.operators.metrics import confusion_matrix, roc_auc
from offerloom.operators.profile import correlations
from offerloom.operators.splits import is_holdout
from offerloom.plans.prepare import CODE_DUMMIES
from offerloom.session import compile_wide_rows
from offerloom.sources.ordered_files import write_ordered
from offerloom.sources.tables import stage_for_fits, write_csv

# The predictors apart from the dummy families, in their usual order.
BASE_PREDICTORS = [
    "campaign_id",
    "coupon_id",
    "customer_id",
    "item_id_x",
    "brand",
    "campaign_x",
    "brand_type_est",
    "brand_type_loc",
    "Married",
    "rented_1",
    "campaign_duration",
    "trans_duration",
    "selling_price_log",
    "other_discount_log",
    "coupon_discount_log",
]


# Dummies whose level may be absent from the data; no row has it then.
OPTIONAL_DUMMIES = ["brand_type_est", "brand_type_loc", "Married", "rented_1", "campaign_x"]


# How many dummies each family of codes has.
FAMILY_SIZES = {"categ_code": 10, "family_code": 4, "age_range_code": 5, "income_code": 11, "no_child_code": 3}
STATED_DUMMIES = [f"{family}_{level}" for family, size in FAMILY_SIZES.items() for level in range(1, size + 1)]
STATED_PREDICTORS = BASE_PREDICTORS + STATED_DUMMIES


def _family_columns(encoded: DataFrame) -> list[str]:
    """Dummies of the code families that the table has."""
    return [
        c for prefix in CODE_DUMMIES.values() for c in encoded.columns if c.startswith(f"{prefix}_") and c not in CODE_DUMMIES
    ]


def with_absent_levels(encoded: DataFrame, stated: bool = False) -> DataFrame:
    """Add an all-zero column for each dummy whose level no row has; with ``stated``, for those of the code families too."""
    wanted = OPTIONAL_DUMMIES + (STATED_DUMMIES if stated else [])
    absent = [c for c in wanted if c not in encoded.columns]
    return encoded.withColumns({c: F.lit(0) for c in absent}) if absent else encoded


def predictors(encoded: DataFrame, stated: bool = False) -> list[str]:
    """Base predictors, then the dummies of each family; a missing name is an error.

    By default these are the dummies that the table has. With ``stated`` they are the ``STATED_PREDICTORS``, always
    the same 48, and a level beyond them is an error, as a model would not see it.
    """
    found = _family_columns(encoded)
    names = STATED_PREDICTORS if stated else BASE_PREDICTORS + found
    missing = [c for c in names if c not in encoded.columns]
    if missing:
        raise ValueError(f"the feature table lacks {', '.join(missing)}")
    unknown = [c for c in found if c not in names]
    if unknown:
        raise ValueError(f"the feature table has levels that are no stated predictors: {', '.join(unknown)}")
    return list(names)


class ModelTable(NamedTuple):
    train: DataFrame
    test: DataFrame
    features: list[str]


def model_table(encoded: DataFrame, stated: bool = False) -> ModelTable:
    """Assembled train and test rows, staged once; a brand given as text is coded. ``stated``: see ``predictors``."""
    compile_wide_rows(encoded.sparkSession)
    encoded = with_absent_levels(encoded, stated)
    if dict(encoded.dtypes)["brand"] == "string":
        encoded = label_encode(encoded, {"brand": "_brand"}).drop("brand").withColumnRenamed("_brand", "brand")
    features = predictors(encoded, stated)
    rows = boosting.assemble(encoded, features, ["id", TARGET, "source"])
    split = split_by_source(stage_for_fits(rows, "model_rows", ["source"]))
    return ModelTable(split.train, split.test, features)


def holdout(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = is_holdout(F.col("id"))
    return train.filter(~held), train.filter(held)


class HoldoutReport(NamedTuple):
    model: GBTClassificationModel | Forest
    auc: DataFrame
    confusion: DataFrame
    scores: DataFrame


def holdout_report(table: ModelTable, params: TreeParams = PARAMS_A) -> HoldoutReport:
    """Fit on three quarters of the train rows, judge on the rest."""
    fit_on, judge_on = holdout(table.train)
    model = boosting.fit(fit_on, params)
    scores = boosting.add_score(model, judge_on).drop("features")
    judged = scores.withColumn("prediction", hard_class(F.col("score")))
    return HoldoutReport(
        model, roc_auc(scores, TARGET, "score"), confusion_matrix(judged, TARGET, "prediction"), scores
    )


def train_and_holdout_auc(table: ModelTable, params: TreeParams = PARAMS_A) -> DataFrame:
    """AUC on the rows that a model was fitted on (source train) and on the others (holdout)."""
    parts = dict(zip(("train", "holdout"), holdout(table.train)))
    model = boosting.fit(parts["train"], params)
    scored = {name: boosting.add_score(model, rows).select(TARGET, "score") for name, rows in parts.items()}
    return roc_auc(union_tagged(scored), TARGET, "score", ["source"])


def top_features(model: GBTClassificationModel | Forest, table: ModelTable, n: int = 15) -> DataFrame:
    return top_rows(boosting.importances(model, table.features, table.train), ["importance"], n, ["feature"])


def submission(template: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """The template's ids with their scores, matched by id and never by position."""
    return template.select("id").join(scores.select("id", F.col(score).alias(TARGET)), "id", "left")


def write_submission(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def write_ordered_submission(template: DataFrame, scores: DataFrame, score: str, path: str, order: Sequence[str]) -> None:
    """The scores in the order of the template, as numbered CSV files; ``order`` are columns of the template."""
    own = [F.col(c).alias(f"_order_{c}") for c in order]
    placed = template.select("id", *own).join(scores.select("id", F.col(score).alias(TARGET)), "id", "left")
    names = [f"_order_{c}" for c in order]
    write_ordered(placed, path, names, drop=names)


class Blend(NamedTuple):
    scores: DataFrame
    best_trees_a: int
    held_out: DataFrame


def blended_scores(
    table: ModelTable,
    params_a: TreeParams = PARAMS_A,
    params_b: TreeParams = PARAMS_B,
    n_folds: int = 10,
    patience: int = 100,
    every: int = 10,
    weights: tuple[float, float] = (0.5, 0.5),
) -> Blend:
    """Model A with a cross-validated number of trees on all train rows, model B averaged over folds.

    All models score a test row where it lies; both scores and their blend are
    columns of that row, and no join brings them together.
    """
    best = selection.cv_tree_count(table.train, params_a, n_folds, patience, every).best_trees
    model_a = boosting.fit(table.train, replace(params_a, trees=best or params_a.trees))
    folded = selection.into_folds(table.train, n_folds)
    models_b = selection.fit_folds(folded, params_b, n_folds, patience, every)
    scored = boosting.add_score(model_a, table.test, "score_a")
    scored = selection.mean_score(scored, models_b, "score_b").drop("features")
    mixed = scored.withColumn("score", blend([F.col("score_a"), F.col("score_b")], weights))
    return Blend(mixed, best, selection.held_out_scores(folded, models_b))


def fold_auc(held_out: DataFrame) -> DataFrame:
    """AUC of each fold on the rows its model has not seen."""
    return roc_auc(held_out, TARGET, "score", ["fold"])


def score_correlation(scores: DataFrame) -> DataFrame:
    """How far the two models agree."""
    return correlations(scores, ["score_a", "score_b"])
