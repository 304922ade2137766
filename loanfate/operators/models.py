"""Models that predict several targets of a loan from the feature table."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanfate.operators.trees import BoostedTargets, fit_boosted_targets
from loanfate.schema import CATEGORY_FEATURES, NUMERIC_FEATURES


def _feature_stages(numeric: list[str], categories: list[str]) -> list:
    vectors = [f"{c}Vec" for c in categories]
    encoder = [OneHotEncoder(inputCols=categories, outputCols=vectors, handleInvalid="keep")] if categories else []
    return [
        *encoder,
        VectorAssembler(inputCols=numeric + vectors, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features"),
    ]


def _learner(target: str, penalty: float) -> LinearRegression:
    columns = {"featuresCol": "features", "labelCol": target, "predictionCol": f"{target}Pred"}
    return LinearRegression(solver="normal", regParam=penalty, **columns)


@dataclass(frozen=True)
class LinearTargets:
    """Straight-line models of several targets on shared inputs, as plain column expressions."""

    numeric: list[str]
    categories: list[str]
    #: By target: intercept, a coefficient per numeric input, and per category one for each level.
    weights: dict[str, tuple[float, list[float], list[list[float]]]]

    def prediction(self, target: str) -> Column:
        intercept, slopes, levels = self.weights[target]
        out = F.lit(intercept)
        for name, slope in zip(self.numeric, slopes):
            out = out + F.col(name).cast("double") * F.lit(slope)
        for name, values in zip(self.categories, levels):
            # A level that the training rows don't have adds nothing.
            if values:
                out = out + F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), F.col(name).cast("int")), F.lit(0.0))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{t}Pred": self.prediction(t) for t in self.weights})


def _levels(train: DataFrame, categories: list[str]) -> list[int]:
    """Levels of indexed categories, from the columns' metadata where all have it, else by one aggregate."""
    known = [train.schema[c].metadata.get("ml_attr", {}).get("vals") for c in categories]
    if all(v is not None for v in known):
        return [len(v) for v in known]
    found = train.agg(*[F.max(c) for c in categories]).first()
    return [0 if v is None else int(v) + 1 for v in found]


def fit_linear_targets(train: DataFrame, targets: list[str], numeric: list[str], categories: list[str], penalty: float = 1e-6) -> LinearTargets:
    """Least squares for all targets by one pass: the products of all inputs and targets, solved once.

    A row is the vector of one, the inputs (a zero-one column per level of an indexed category)
    and the targets; its products are summed by the tasks, and what reaches the driver is one small
    matrix. ``penalty`` is the ridge of a target's standardised equations, as
    :class:`LinearRegression` with the normal solver has it. Inputs without spread get no slope.
    """
    sizes = _levels(train, categories)
    hot = [F.when(F.col(c) == k, 1.0).otherwise(0.0).alias(f"_{c}_{k}") for c, n in zip(categories, sizes) for k in range(n)]
    columns = [F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in numeric], *hot,
               *[F.col(t).cast("double").alias(f"_y_{t}") for t in targets]]
    rows = train.select(*columns)
    vectors = VectorAssembler(inputCols=rows.columns, outputCol="v").transform(rows).select("v")
    sums = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    n = sums[0, 0]
    mean = sums[0] / n
    spread = sums / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    width = len(rows.columns) - 1 - len(targets)
    used = [j for j in range(1, 1 + width) if scale[j] > 1e-12 * max(1.0, abs(mean[j]))]
    weights = {}
    for k, target in enumerate(targets):
        y = 1 + width + k
        slopes = np.zeros(width)
        if scale[y] > 0 and used:
            within = spread[np.ix_(used, used)] / np.outer(scale[used], scale[used])
            toward = spread[used, y] / (scale[used] * scale[y])
            within[np.diag_indices(len(used))] += penalty / scale[y]
            solved = np.linalg.lstsq(within, toward, rcond=None)[0]
            slopes[[j - 1 for j in used]] = solved * scale[y] / scale[used]
        intercept = mean[y] - slopes @ mean[1:1 + width]
        held = [float(v) for v in slopes]
        levels, at = [], len(numeric)
        for size in sizes:
            levels.append(held[at:at + size])
            at += size
        weights[target] = (float(intercept), held[:len(numeric)], levels)
    return LinearTargets(list(numeric), list(categories), weights)


def fit_multi_target(
    train: DataFrame,
    targets: list[str],
    learner: str = "linear",
    seed: int = 1,
    numeric: list[str] = NUMERIC_FEATURES,
    categories: list[str] = CATEGORY_FEATURES,
    penalty: float = 1e-6,
) -> PipelineModel | LinearTargets | BoostedTargets:
    """Fit one regression per target on shared features.

    The inputs are the ``numeric`` columns and those of ``categories`` that are present. The
    linear learner fits all targets in one pass (:func:`fit_linear_targets`); its small ``penalty``
    keeps the normal equations solvable when inputs are collinear. ``gbt`` grows boosted trees of all
    targets, a pass over small binned rows for a level (:func:`fit_boosted_targets`). ``separate`` fits the lines of ``linear``
    one target at a time. For it the feature vectors are made once, kept while the fits
    run, and released. The targets do not depend on each other, so their fits are submitted side
    by side and share the cluster.
    """
    if learner not in ("linear", "separate", "gbt"):
        raise ValueError(f"learner must be 'linear', 'separate' or 'gbt', got {learner!r}")
    present = [c for c in categories if c in train.columns]
    if learner == "linear":
        return fit_linear_targets(train, targets, list(numeric), present, penalty)
    if learner == "gbt":
        return fit_boosted_targets(train, targets, list(numeric), present, _levels(train, present) if present else [], seed)
    features = Pipeline(stages=_feature_stages(list(numeric), present)).fit(train)
    encoded = features.transform(train).select("features", *targets).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(target):
        return _learner(target, penalty).fit(encoded)

    try:
        with ThreadPoolExecutor(max_workers=len(targets)) as pool:
            models = list(pool.map(inheritable_thread_target(train.sparkSession)(fit), targets))
    finally:
        encoded.unpersist()
    return PipelineModel(stages=[*features.stages, *models])


def prediction_table(model: PipelineModel | LinearTargets | BoostedTargets, test: DataFrame, targets: list[str]) -> DataFrame:
    """Predictions beside the actual values."""
    return model.transform(test).select(*[f"{t}Pred" for t in targets], *targets)


def mse_table(predictions: DataFrame, targets: list[str]) -> DataFrame:
    """Mean squared error per target, and over all of them."""
    def squared_error(t):
        gap = F.col(f"{t}Pred") - F.col(t)
        return gap * gap

    errors = predictions.agg(*[F.avg(squared_error(t)).alias(t) for t in targets])
    overall = sum((F.col(t) for t in targets), F.lit(0.0)) / len(targets)
    rows = [F.struct(F.lit(t).alias("target"), F.col(t).alias("mse")) for t in targets]
    rows.append(F.struct(F.lit("all").alias("target"), overall.alias("mse")))
    return errors.select(F.inline(F.array(*rows)))
