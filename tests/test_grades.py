import random
import statistics

import pytest
from pyspark.sql import functions as F

from loanfate.operators import grades, summary

MEASURES = {
    "def": (lambda l: True, lambda l: l["loan_status"]),
    "ER": (lambda l: True, lambda l: float(l["loan_status"] == 0 and l["fracNumPmts"] < 1)),
    "defTime": (lambda l: l["loan_status"] == 1, lambda l: l["fracNumPmts"]),
    "repTime": (lambda l: l["loan_status"] == 0, lambda l: l["fracNumPmts"]),
    "ERTime": (lambda l: l["loan_status"] == 0 and l["fracNumPmts"] < 1, lambda l: l["fracNumPmts"]),
}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for i in range(600):
        grade = draw.choice("AABBCDE")
        out.append({
            "grade": grade,
            "term": "36" if grade == "E" or draw.random() < 0.6 else "60",  # E has no 60 month loan
            "loan_status": 0.0 if grade == "D" else float(draw.random() < 0.3),  # D never defaults
            "fracNumPmts": round(draw.uniform(0, 1.2), 3),
            "loan_amnt": draw.uniform(1000, 30000),
            "installment": draw.uniform(50, 900),
        })
    for row in out:
        row["term2"] = float(row["term"])
        row["mnth_start2last"] = row["fracNumPmts"] * row["term2"]
    return out


@pytest.fixture(scope="module")
def loans(spark, rows):
    return spark.createDataFrame(rows).repartition(5).cache()


def brute(rows, grade, name, term):
    population, value = MEASURES[name]
    values = [value(r) for r in rows if r["grade"] == grade and r["term2"] == term and population(r)]
    mean = statistics.fmean(values) if values else None
    sd = statistics.stdev(values) if len(values) > 1 else None
    return mean, sd


def close(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def test_grade_performance_equals_brute_force(loans, rows):
    table = {r.grade: r for r in grades.grade_performance(loans, keep="all").collect()}
    assert sorted(table) == ["A", "B", "C", "D", "E"]
    for grade, row in table.items():
        for name in MEASURES:
            for term in (36, 60):
                mean, sd = brute(rows, grade, name, term)
                assert close(row[f"{name}{term}mean"], mean) and close(row[f"{name}{term}sd"], sd)


def test_complete_grades_are_those_of_the_join_chain(loans):
    early = F.when((F.col("fracNumPmts") < 1) & (F.col("loan_status") == 0), 1).otherwise(0)
    flagged = loans.withColumn("ER", early)
    chain = loans.select("grade").distinct()
    for term in (36, 60):
        for where in ("true", "loan_status = 1", "ER = 1"):
            part = flagged.filter(f"term2 = {term}").filter(where).groupBy("grade").count().drop("count")
            chain = chain.join(part, "grade", "inner")
    kept = [r.grade for r in grades.grade_performance(loans).collect()]
    assert kept == sorted(r.grade for r in chain.collect()) == ["A", "B", "C"]


def test_indicator_sd_gives_group_size(loans, rows):
    row = grades.grade_performance(loans).filter("grade = 'A'").first()
    p, n = row.def36mean, sum(r["grade"] == "A" and r["term2"] == 36 for r in rows)
    assert row.def36sd ** 2 == pytest.approx(p * (1 - p) * n / (n - 1))


def test_display_units(loans):
    table = grades.grade_performance(loans)
    raw, shown = table.first(), grades.grade_display_table(table).first()
    assert shown.defaultPct36 == pytest.approx(100 * raw.def36mean)
    assert shown.repayPct60 == pytest.approx(100 - 100 * raw.def60mean)
    assert shown.defaultMonth60 == pytest.approx(60 * raw.defTime60mean)
    assert shown.repayMonth36 == pytest.approx(36 * raw.repTime36mean)


def test_breakeven_is_ratio_of_means(loans, rows):
    table = {r.grade: r.breakeven for r in grades.breakeven_installments(loans, 60).collect()}
    chosen = [r for r in rows if r["grade"] == "B" and r["term2"] == 60 and r["loan_status"] == 0]
    ratio = sum(r["loan_amnt"] for r in chosen) / sum(r["installment"] for r in chosen)
    assert table["B"] == pytest.approx(ratio)
    means = {r.grade: r.mean_loan_amnt for r in grades.grade_means(loans, "loan_amnt").collect()}
    assert means["B"] == pytest.approx(statistics.fmean(r["loan_amnt"] for r in chosen))


def test_mean_times(loans, rows):
    by_term = {r.term: r.mean_frac for r in grades.mean_frac_by_term(loans).collect()}
    assert by_term["36"] == pytest.approx(statistics.fmean(r["fracNumPmts"] for r in rows if r["term"] == "36"))
    repaid = [r["fracNumPmts"] for r in rows if r["term2"] == 60 and r["loan_status"] == 0]
    assert grades.mean_repay_months(loans).first().mean_months == pytest.approx(60 * statistics.fmean(repaid))


def test_counts_and_summary(loans, rows):
    counts = summary.category_counts(loans, "grade").collect()
    assert [r["count"] for r in counts] == sorted((r["count"] for r in counts), reverse=True)
    rising = summary.category_counts(loans, "grade", ascending=True).collect()
    assert rising[0]["count"] <= rising[-1]["count"]
    described = {r.column: r for r in summary.summarize(loans, ["loan_amnt", "fracNumPmts"]).collect()}
    values = sorted(r["loan_amnt"] for r in rows)
    row = described["loan_amnt"]
    assert row["count"] == 600 and row["min"] == values[0] and row["max"] == values[-1]
    assert row["mean"] == pytest.approx(statistics.fmean(values))
    assert row["stddev"] == pytest.approx(statistics.stdev(values))
    assert row["q50"] in values[298:302]


def test_grid_quantiles(loans, rows):
    table = {r.grade: r for r in summary.repay_quantiles(loans).collect()}
    times = sorted(r["mnth_start2last"] for r in rows if r["grade"] == "A" and r["term2"] == 60 and r["loan_status"] == 0)
    for name, cut in zip(("p25", "p50", "p75"), statistics.quantiles(times, n=4, method="inclusive")):
        assert table["A"][name] == pytest.approx(cut)
    whole = summary.grid_quantiles(loans, "fracNumPmts", (0.0, 1.0)).first()
    assert (whole.p0, whole.p100) == (min(r["fracNumPmts"] for r in rows), max(r["fracNumPmts"] for r in rows))


def test_cardinality(spark):
    data = spark.createDataFrame([(i % 3, i % 40) for i in range(200)], "a int, b int")
    table = {r.column: (r.levels, r.embedding_width) for r in summary.category_cardinality(data, ["a", "b"]).collect()}
    assert table == {"a": (3, 2), "b": (40, 10)}
