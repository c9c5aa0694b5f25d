"""Both halves in a row: raw tables to encoded table, encoded table to submission."""

from __future__ import annotations

from pyspark.sql import DataFrame

from offerloom.models.boosting import PARAMS_A, PARAMS_B, TreeParams
from offerloom.plans import modelling, prepare
from offerloom.plans.prepare import Demographics
from offerloom.sources.campaign import CampaignData
from offerloom.sources.tables import read_parquet, write_parquet


def prepare_features(data: CampaignData, path: str, demographics: Demographics = "ffill") -> DataFrame:
    """Write the encoded table, train and test rows in folders of their own, and read it back."""
    write_parquet(prepare.feature_table(data, demographics), path, ["source"])
    return read_parquet(data.impressions.sparkSession, path)


def predict(
    encoded: DataFrame,
    template: DataFrame,
    path: str,
    params_a: TreeParams = PARAMS_A,
    params_b: TreeParams = PARAMS_B,
    n_folds: int = 10,
    patience: int = 100,
    every: int = 10,
    stated: bool = False,
) -> modelling.Blend:
    """Fit and blend both models and write the submission. ``stated``: see ``modelling.predictors``."""
    table = modelling.model_table(encoded, stated)
    blend = modelling.blended_scores(table, params_a, params_b, n_folds, patience, every)
    modelling.write_submission(modelling.submission(template, blend.scores, "score"), path)
    return blend
