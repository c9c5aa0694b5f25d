"""Boosted trees with Spark ML: two parameter sets, fitting and scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.models import forest, histograms
from offerloom.models.forest import Forest
from offerloom.models.histograms import Coded
from offerloom.operators.combine import TARGET
from offerloom.session import ensure_checkpoint_folder

#: Fits of so many trees on a table that one task can hold are not left to Spark ML.
MANY_TREES = 20
#: Rows that fits beside each other hold at most, all taken together.
ROWS_AT_ONCE = 4 * histograms.ROWS_IN_TASK

# A predictor that is missing gets a value of its own, below all real ones.
MISSING = -1.0


@dataclass(frozen=True)
class TreeParams:
    trees: int
    step: float
    depth: int
    row_share: float = 1.0
    feature_share: float = 1.0
    min_rows: int = 1
    positive_weight: float = 1.0
    seed: int = 26
    #: For ``rounds``: most leaves of a tree, grown best-first within ``depth``; and the least loss reduction of a split.
    leaves: int | None = None
    gamma: float = 0.0


# Deep trees with small steps and weighted positives, and shallower
# trees with larger steps (2**5 leaves stand for a limit of 31 in ``fit``).
PARAMS_A = TreeParams(
    trees=1000, step=0.01, depth=8, row_share=0.9, feature_share=0.9, min_rows=3, positive_weight=50.0, gamma=0.5
)
PARAMS_B = TreeParams(trees=1000, step=0.07, depth=5, feature_share=0.9)
#: The same with 31 leaves grown best-first, for ``rounds``; a path of 12 splits is as deep as it goes.
PARAMS_B_LEAVES = TreeParams(trees=1000, step=0.07, depth=12, feature_share=0.9, leaves=31)


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Predictors in one vector column; of the other columns only ``keep`` stays."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in features]
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    wide = assembler.transform(df.select(*kept, *filled))
    return wide.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "features")


def classifier(params: TreeParams) -> GBTClassifier:
    return GBTClassifier(
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
        maxIter=params.trees,
        stepSize=params.step,
        maxDepth=params.depth,
        subsamplingRate=params.row_share,
        featureSubsetStrategy="all" if params.feature_share == 1.0 else str(params.feature_share),
        minInstancesPerNode=params.min_rows,
        # Rows walk the one tree that is growing; a kept row-to-node map is written anew on every level and took longer.
        cacheNodeIds=False,
        checkpointInterval=10,
        maxMemoryInMB=512,
        seed=params.seed,
    )


def with_label(rows: DataFrame, params: TreeParams, target: str = TARGET) -> DataFrame:
    weight = F.when(F.col(target) == 1, params.positive_weight).otherwise(1.0)
    return rows.withColumns({"label": F.col(target).cast("double"), "weight": weight})


def fit(rows: DataFrame | Coded, params: TreeParams, target: str = TARGET) -> GBTClassificationModel | Forest:
    """Fit on assembled rows that hold the target: short fits of small tables by Spark ML, all others on binned rows."""
    plain = asdict(replace(params, leaves=None, gamma=0.0))
    if isinstance(rows, Coded):
        return histograms.fit_in_passes(rows, plain)
    ensure_checkpoint_folder(rows.sparkSession)
    labelled = with_label(rows, params, target)
    if rows.count() > histograms.ROWS_IN_TASK:
        return histograms.fit_in_passes(labelled, plain)
    if params.trees >= MANY_TREES:
        return histograms.fit_in_task(labelled, plain)
    return classifier(params).fit(labelled.select("features", "label", "weight"))


def for_fits(rows: DataFrame, params: TreeParams, groups: Sequence[str], target: str = TARGET) -> DataFrame | Coded:
    """What several fits filter by ``groups``: the rows, or for a long table its codes, which are made once for all fits."""
    if rows.count() <= histograms.ROWS_IN_TASK:
        return rows
    return histograms.coded_once(with_label(rows, params, target), groups)


def fits_at_once(rows: DataFrame, params: TreeParams, fits: int, parallelism: int) -> int:
    """How many of ``fits`` on ``rows`` run beside each other: ``parallelism``, or more if each is one task."""
    n = rows.count() if params.trees >= MANY_TREES else 0
    return max(parallelism, min(fits, ROWS_AT_ONCE // n)) if 0 < n <= histograms.ROWS_IN_TASK else parallelism


def add_score(
    model: GBTClassificationModel | Forest, rows: DataFrame, name: str = "score", n_trees: int | None = None
) -> DataFrame:
    """Probability of the positive class as one more column; ``n_trees`` uses the first trees only.

    Scoring only maps rows, so any number of models can be applied one after the
    other without a shuffle.
    """
    if isinstance(model, GBTClassificationModel):
        if n_trees in (None, model.getNumTrees):
            scored = model.transform(rows)
            return scored.select(*rows.columns, vector_to_array("probability")[1].alias(name))
        model = flat(model, rows)
    trees = model if n_trees is None else model.first(n_trees)
    return forest.add_margin(trees, rows, "_m").withColumn(name, probability(F.col("_m"))).drop("_m")


def probability(margin: Column) -> Column:
    """What a margin means as a probability under the loss the trees are fitted to."""
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def flat(model: GBTClassificationModel | Forest, rows: DataFrame) -> Forest:
    return model if isinstance(model, Forest) else forest.of_model(rows.sparkSession, model)


def staged_margins(model: GBTClassificationModel | Forest, rows: DataFrame, tree_counts: Sequence[int]) -> DataFrame:
    """The margin after the first n trees, in long form (``n_trees``, ``margin``), for each n asked for.

    Boosting only ever adds trees, so one model of 1000 trees holds every smaller one. All trees are
    walked in one pass; for the AUC of many numbers of trees, ``forest.auc_bounds`` writes no long form.
    """
    return forest.long_margins(flat(model, rows), rows, tree_counts)


def importances(model: GBTClassificationModel | Forest, features: Sequence[str], rows: DataFrame) -> DataFrame:
    """(feature, importance), one row per predictor."""
    shares = forest.gain_importances(model, len(features)) if isinstance(model, Forest) else model.featureImportances.toArray()
    values = [(name, float(v)) for name, v in zip(features, shares)]
    return rows.sparkSession.createDataFrame(values, "feature string, importance double")
