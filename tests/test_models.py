import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanfate.operators import evaluate, models
from loanfate.operators.clean import split_train_test
from loanfate.plans import studies
from loanfate.schema import COUNTERFACTUAL_TARGETS, NUMERIC_FEATURES, SIMPLE_TARGETS


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = []
    for i in range(600):
        x = [draw.uniform(0, 1) for _ in NUMERIC_FEATURES]
        grade = float(draw.randrange(3))
        p = 1.0 if x[1] + 0.3 * grade + draw.gauss(0, 0.1) > 0.9 else 0.0
        rows.append((i, *x, 0.0, grade, p, 0.5 * x[0] + 0.1 * grade, 1 - p, 0.3 + 0.2 * x[2], 0.4 * x[3]))
    names = ["loan_id", *NUMERIC_FEATURES, "term", "grade", "probDef", "timeDef", "probER", "timeER", "fracNumPmts"]
    return spark.createDataFrame(rows, names).repartition(3).cache()


@pytest.mark.parametrize("learner", ["linear", "gbt"])
def test_predictions_beat_the_mean(table, learner):
    predictions = studies.predict_targets(table, COUNTERFACTUAL_TARGETS, learner).cache()
    assert predictions.columns == [f"{t}Pred" for t in COUNTERFACTUAL_TARGETS] + COUNTERFACTUAL_TARGETS
    assert predictions.count() == split_train_test(table)[1].count()
    errors = {r.target: r.mse for r in models.mse_table(predictions, COUNTERFACTUAL_TARGETS).collect()}
    data = predictions.toPandas()
    for t in COUNTERFACTUAL_TARGETS:
        assert errors[t] == pytest.approx(((data[f"{t}Pred"] - data[t]) ** 2).mean())
        assert errors[t] < data[t].var()
    assert errors["all"] == pytest.approx(np.mean([errors[t] for t in COUNTERFACTUAL_TARGETS]))


def test_same_seed_same_result(table):
    train, test = split_train_test(table.coalesce(1))
    runs = [
        models.prediction_table(models.fit_multi_target(train, ["timeDef"], "gbt", seed=3), test, ["timeDef"]).collect()
        for _ in range(2)
    ]
    assert sorted(r[0] for r in runs[0]) == pytest.approx(sorted(r[0] for r in runs[1]))


@pytest.fixture(scope="module")
def predictions(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        d = float(draw.random() < 0.3)
        e = float(d == 0 and draw.random() < 0.5)
        rows.append((d, e, round(draw.uniform(0, 1), 2), draw.random(), draw.random(), draw.random()))
    return spark.createDataFrame(rows, [*SIMPLE_TARGETS, *[f"{t}Pred" for t in SIMPLE_TARGETS]]).cache()


def test_calibration(predictions):
    data = predictions.toPandas()
    table = {r.event: (r.actual, r.predicted) for r in evaluate.calibration_table(predictions).collect()}
    assert table["Default"] == pytest.approx((100 * data.probDef.mean(), 100 * data.probDefPred.mean()))
    original = 1 - data.probDef - data.probER
    assert table["Orig. Term"][0] == pytest.approx(100 * original.mean())
    assert sum(a for a, _ in table.values()) == pytest.approx(100)


def test_event_predictions(predictions):
    chosen = evaluate.event_predictions(predictions, "probER", "fracNumPmts")
    data = predictions.toPandas()
    assert chosen.columns == ["actual", "predicted"]
    assert chosen.count() == int((data.probER == 1).sum())


def test_density_against_numpy(predictions):
    times = evaluate.event_predictions(predictions, "probDef", "fracNumPmts")
    density = evaluate.event_time_density(evaluate.stack_series(times, ["actual", "predicted"]))
    got = {(r.series, round(r.x, 2)): r.density for r in density.collect()}
    data = times.toPandas()
    grid = np.arange(0, 1, 0.01)
    assert len(got) == 200
    for name in ("actual", "predicted"):
        values = data[name].to_numpy()
        h = values.std(ddof=1) * len(values) ** -0.2
        z = (grid[:, None] - values[None, :]) / h
        expected = np.exp(-z * z / 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
        for x, height in zip(grid, expected):
            assert got[name, round(float(x), 2)] == pytest.approx(height, rel=1e-9)
            assert height >= 0


def test_density_of_equal_times_is_null_and_the_rest_stays(spark):
    rows = [("same", 0.5)] * 4 + [("one", 0.2)] + [("spread", x / 10) for x in range(10)] + [("same", None)]
    times = spark.createDataFrame(rows, "series string, time double")
    for resolution in (None, 1 / 4096):
        shown = evaluate.event_time_density(times, resolution=resolution).collect()
        assert len(shown) == 300
        assert {r.series for r in shown if r.density is None} == {"same", "one"}
        assert all(r.density is not None for r in shown if r.series == "spread")


def test_density_counts_equal_times_before_the_grid(spark):
    """Times meet the grid as counts of equal ones: 30 rows for 90,000 times."""
    times = spark.range(90_000).selectExpr("concat('s', id % 3) AS series", "(id % 10) / 20 AS time")
    shown = evaluate.event_time_density(times)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    generate = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert any("Aggregate" in line for line in lines[generate:]) and shown.count() == 300


def test_density_of_rounded_times_is_within_a_thousandth(spark):
    """Continuous times at a resolution of a fiftieth of the bandwidth, as the docstring says."""
    rng = np.random.default_rng(8)
    values = np.clip(rng.beta(2, 3, 20_000) + 0.01 * rng.standard_normal(20_000), 0, 1.2)
    times = spark.createDataFrame([("a", float(v)) for v in values], "series string, time double")
    width = values.std(ddof=1) * len(values) ** -0.2
    exact, rounded = (
        np.array([r.density for r in evaluate.event_time_density(times, resolution=r).orderBy("x").collect()]) for r in (None, width / 50)
    )
    assert np.abs(exact - rounded).max() < 1e-3 * exact.max()


def test_one_pass_equals_separate_fits(spark):
    """All targets by one matrix of sums, with collinear inputs, an input without spread and a constant target."""
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 1e4, 0.01] + [5, 6e4, 0]
    grade, term = rng.integers(0, 5, n), rng.integers(0, 2, n)
    y1 = x[:, 0] - 2e-4 * x[:, 1] + grade + rng.normal(size=n)
    y2 = (rng.random(n) < 0.3 + 0.1 * term).astype(float)
    rows = [(*map(float, r), 7.0, float(g), float(t), float(a), float(b), 3.0) for r, g, t, a, b in zip(x, grade, term, y1, y2)]
    train = spark.createDataFrame(rows, "a double, b double, c double, same double, grade double, term double, y1 double, y2 double, y3 double")
    targets, numeric, categories = ["y1", "y2", "y3"], ["a", "b", "c", "same"], ["grade", "term"]
    one, each = (models.fit_multi_target(train, targets, k, numeric=numeric, categories=categories) for k in ("linear", "separate"))
    assert isinstance(one, models.LinearTargets)
    got, want = (m.transform(train).select(*[f"{t}Pred" for t in targets]).toPandas().to_numpy() for m in (one, each))
    assert np.abs(got - want).max() < 1e-7
    design = np.column_stack([np.ones(n), x, np.eye(5)[grade], np.eye(2)[term]])
    assert np.allclose(got[:, 0], design @ np.linalg.lstsq(design, y1, rcond=None)[0], atol=1e-4)
    # A level that the training rows lack adds nothing.
    odd = train.limit(1).withColumn("grade", F.lit(9.0))
    assert one.transform(odd).first().y1Pred is not None


def test_lines_of_two_targets(spark):
    train = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 3).cast("double").alias("z"))
    model = models.fit_multi_target(train, ["y", "z"], numeric=["x"], categories=[])
    assert model.weights["y"][0] == pytest.approx(0, abs=1e-3) and model.weights["y"][1][0] == pytest.approx(2, abs=1e-5)
