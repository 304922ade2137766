"""Boosted trees of several targets against GBTRegressor, which they replace."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from loanfate.operators import models, trees

TARGETS, NUMERIC, CATEGORIES = ["y1", "y2", "y3"], ["a", "b", "zeros", "same"], ["grade", "term"]


@pytest.fixture(scope="module")
def table(spark):
    """More rows than are sampled; an input that is mostly zero, one without spread, and a constant target."""
    rng = np.random.default_rng(21)
    n = 13_000
    a, b, zeros = rng.normal(size=n), rng.integers(0, 9, n).astype(float), np.where(rng.random(n) < 0.7, 0.0, rng.random(n))
    grade, term = rng.integers(0, 5, n), rng.integers(0, 2, n)
    y1 = np.where(a > 0.3, b, 2.0) + 3 * (grade == 2) + rng.normal(size=n)
    y2 = (rng.random(n) < 0.2 + 0.3 * term + 0.3 * zeros).astype(float)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, zeros, np.full(n, 7.0), grade, term, y1, y2, np.full(n, 3.0)))]
    return spark.createDataFrame(rows, ["id", *NUMERIC, *CATEGORIES, *TARGETS]).repartition(3, "id").sortWithinPartitions("id").cache()


def test_trees_are_those_of_spark(table):
    train, test = table.filter("id < 12000"), table.filter("id >= 12000")
    features = Pipeline(stages=models._feature_stages(NUMERIC, CATEGORIES)).fit(train)
    encoded, want = features.transform(train).cache(), features.transform(test)
    for t in TARGETS:
        learner = GBTRegressor(maxIter=10, maxDepth=5, seed=5, featuresCol="features", labelCol=t, predictionCol=f"{t}Pred")
        want = learner.fit(encoded).transform(want)
    model = models.fit_multi_target(train, TARGETS, "gbt", seed=5, numeric=NUMERIC, categories=CATEGORIES)
    assert isinstance(model, trees.BoostedTargets)
    columns = ["id", *[f"{t}Pred" for t in TARGETS]]
    got, want = (df.select(*columns).orderBy("id").toPandas().to_numpy() for df in (model.transform(test), want))
    assert got.shape == want.shape == (1000, 4) and np.abs(got - want).max() < 1e-9
    # A level that the training rows don't have is none of theirs, and a null is an error, as before.
    odd = test.limit(1).withColumn("grade", F.lit(9.0))
    assert model.transform(odd).first().y1Pred is not None
    with pytest.raises(Exception, match="null or NaN in a"):
        model.transform(odd.withColumn("a", F.lit(None).cast("double"))).collect()


def test_no_row_object_is_kept(spark, table, monkeypatch):
    """Nothing stays in executor storage while trees grow, and no file of theirs stays after."""
    held, paths, grow, scratch = [], [], trees._grow, trees.scratch_path
    table.count()
    stored = spark._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(trees, "scratch_path", lambda s: paths.append(scratch(s)) or paths[-1])
    monkeypatch.setattr(trees, "_grow", lambda *args: held.append(spark._jsc.getPersistentRDDs().size()) or grow(*args))
    models.fit_multi_target(table, ["y1"], "gbt", numeric=["a"], categories=[])
    assert len(held) == len(paths) == 10 and max(held) <= stored
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@pytest.mark.parametrize("values, expected, want", [
    ([1.0, 2.0, 2.0, 4.0], 4, [1.5, 3.0]),
    ([0.0, 0.0, 2.0], 3, [1.0]),
    ([5.0, 5.0], 2, []),
    ([0.0], 1, []),
])
def test_thresholds_of_few_values(values, expected, want):
    assert trees.quantile_thresholds(np.array(values), expected).tolist() == want


def test_thresholds_of_many_values_cut_even_parts():
    cuts = trees.quantile_thresholds(np.arange(1.0, 3201.0), 3200)
    parts = np.diff(np.concatenate([[0], cuts, [3200.5]]))
    assert len(cuts) == trees.BINS - 1 and parts.max() - parts.min() <= 2
