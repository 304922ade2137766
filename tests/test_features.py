from collections import Counter
import random

import pytest
from pyspark.sql import functions as F

from loanfate.operators import features
from loanfate.functions import hash_uniform


@pytest.fixture(scope="module")
def published(spark):
    """1550 defaults, 5145 early repayments, 2581 on time, 7 defaults after the term."""
    groups = [(1550, 1.0, 0.4438), (5145, 0.0, 0.5443), (2581, 0.0, 1.0), (7, 1.0, 1.2)]
    rows, key = [], 0
    for n, status, frac in groups:
        rows += [(key + i, status, frac) for i in range(n)]
        key += n
    rows += [(key, None, 0.2), (key + 1, 2.0, 0.3)]
    return spark.createDataFrame(rows, "loan_id long, loan_status double, fracNumPmts double").repartition(6).cache()


def test_published_thresholds(published):
    stats = features.outcome_stats(published).first()
    assert (stats.def_count, stats.er_count, stats.on_time_count) == (1550, 5145, 2581)
    assert round(stats.threshold_not_er, 4) == 0.3752
    assert round(stats.threshold_not_def, 4) == 0.6659
    assert stats.avg_def_time == pytest.approx(0.4438) and stats.avg_er_time == pytest.approx(0.5443)


def test_targets(published):
    counts = features.add_targets(published).agg(F.sum("probDef").alias("d"), F.sum("probER").alias("e"), F.count("*").alias("n")).first()
    assert (counts.d, counts.e, counts.n) == (1557, 5145, 9285)
    assert features.add_targets(published, resolved_only=True).count() == 9283


def test_counterfactual_times(published):
    rows = features.counterfactual_times(published).withColumn("u", hash_uniform("loan_id", 7)).collect()
    stats = features.outcome_stats(published).first()
    for r in rows:
        not_def = 1.0 if r.u > stats.threshold_not_def else stats.avg_er_time
        not_er = 1.0 if r.u > stats.threshold_not_er else stats.avg_def_time
        assert r.timeDef == pytest.approx(r.fracNumPmts if r.loan_status == 1 else not_def)
        early = r.loan_status == 0 and r.fracNumPmts < 1
        assert r.timeER == pytest.approx(r.fracNumPmts if early else not_er)
    drawn = [r for r in rows if r.probDef == 0]
    assert sum(r.timeDef < 1 for r in drawn) / len(drawn) == pytest.approx(0.6659, abs=0.03)


@pytest.fixture(scope="module")
def loans(spark):
    draw = random.Random(5)
    rows = [(
        i, draw.uniform(1e3, 3e4), draw.uniform(5, 25), draw.uniform(2e4, 1e5), draw.uniform(0, 40) if i % 50 else None,
        draw.uniform(0, 100), draw.uniform(50, 900), draw.choice(["36", "36", "60"]), draw.choice("ABC"),
        draw.choice(["OWN", "RENT"]) if i != 7 else None, draw.choice(["1 year", "n/a"]),
        draw.choice([0.0, 0.0, 1.0, None]), draw.uniform(0, 1.2),
    ) for i in range(400)]
    return spark.createDataFrame(rows, (
        "loan_id long, loan_amnt double, int_rate double, annual_inc double, dti double, revol_util double, "
        "installment double, term string, grade string, home_ownership string, emp_length string, "
        "loan_status double, fracNumPmts double")).repartition(4).cache()


def test_index_by_frequency_then_label(spark):
    data = spark.createDataFrame([(x,) for x in "bbbaaacd"], "c string")
    table = {r.level: (r.idx, r["count"]) for r in features.category_index(data, ["c"]).collect()}
    assert table == {"a": (0.0, 3), "b": (1.0, 3), "c": (2.0, 1), "d": (3.0, 1)}


def test_model_table_keeps_complete_rows(loans):
    table = features.model_table(loans)
    rows = table.collect()
    assert len(rows) == 400 - 8 - 1  # every 50th lacks dti, one lacks ownership
    assert {"probDef", "timeDef", "probER", "timeER", "fracNumPmts", "inst2inc"} <= set(table.columns)
    assert {r.grade for r in rows} == {0.0, 1.0, 2.0}
    unknown = {r.loan_id for r in loans.filter("loan_status is null").collect()}
    assert any(r.loan_id in unknown and r.probDef == r.probER == 0.0 for r in rows)
    resolved = features.model_table(loans, resolved_only=True)
    assert not unknown & {r.loan_id for r in resolved.collect()}


def test_statistics_stay_inside_the_query(loans):
    timed = features.counterfactual_times(loans)
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "Join" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_index_of_many_levels_is_the_rank(spark, partitions):
    """Frequencies with many ties, one level in a third of the rows, nulls: the order of a plain sort."""
    values = [None] * 5 + ["hot"] * 900 + [f"v{i % 700}" for i in range(1500)] + [f"w{i}" for i in range(300)]
    table = spark.createDataFrame([(v,) for v in values], "v string").repartition(partitions)
    counts = Counter(v for v in values if v is not None)
    want = {v: (n, k) for k, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    assert {r.level: (r["count"], r.idx) for r in features.level_index(table, "v").collect()} == want
    indexed = features.index_large_category(table, "v")
    assert Counter((r.v, r.vIdx) for r in indexed.collect()) == {(v, float(k)): n for v, (n, k) in want.items()}
    assert features.level_index(table.filter("v IS NULL"), "v").count() == 0
