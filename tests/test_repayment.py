import random

import numpy as np
import pytest

from loanfate.operators import repayment


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    out = []
    for i in range(900):
        rate, dti = draw.uniform(5, 25), draw.uniform(0, 40)
        home = draw.choice(["OWN", "RENT", "RENT", "MORTGAGE", "MORTGAGE", "MORTGAGE"])
        frac = 0.9 - 0.01 * rate + 0.002 * dti + (0.05 if home == "RENT" else 0.0) + draw.gauss(0, 0.05)
        out.append((
            draw.uniform(50, 900), draw.uniform(2e4, 2e5), dti, rate, draw.uniform(0, 100), home,
            draw.choice("AABBBC"), draw.choice(["n/a", "3 years", "3 years", "7 years", "10+ years"]),
            draw.choice(["No desc.", "No desc.", "Generic desc."]), frac, float(i % 9 == 0), 60.0 if i % 5 else 36.0,
        ))
    return out


@pytest.fixture(scope="module")
def design(spark, rows):
    loans = spark.createDataFrame(rows, (
        "installment double, annual_inc double, dti double, int_rate double, revol_util double, home_ownership string, "
        "grade string, emp_length string, pred_KM string, fracNumPmts double, loan_status double, term2 double"))
    return repayment.repayment_design(repayment.bucket_categories(loans)).cache()


def test_only_repaid_loans_of_the_term(design, rows):
    assert design.count() == sum(r[10] == 0 and r[11] == 60 for r in rows)


def test_feature_names_skip_the_rarest_level(design):
    names = repayment.feature_names(design)
    assert names[:5] == ["installment", "annual_inc", "dti", "int_rate", "revol_util"]
    assert "home_ownership_OWN" not in names and "home_ownership_RENT" in names
    assert len(names) == 5 + 2 + 2 + 3 + 1


def test_least_squares_against_numpy(design):
    model = repayment.fit_repayment_ols(design)
    data = design.select("features", "label").collect()
    x = np.array([r.features.toArray() for r in data])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r.label for r in data])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert model.coefficients.toArray() == pytest.approx(beta[:-1], rel=1e-5, abs=1e-9)
    assert model.intercept == pytest.approx(beta[-1], rel=1e-6)
    residual = y - x @ beta
    sigma2 = residual @ residual / (len(y) - x.shape[1])
    t = beta / np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))
    assert model.summary.tValues == pytest.approx(list(t), rel=1e-4, abs=1e-4)


def test_effects_in_months(design):
    model = repayment.fit_repayment_ols(design)
    table = {r.feature: r for r in repayment.effect_table(model, design).collect()}
    assert table["int_rate"].months == pytest.approx(-0.6, abs=0.1)
    assert table["dti"].change == 10.0 and table["dti"].months == pytest.approx(1.2, abs=0.2)
    assert table["annual_inc"].change == 10000.0 and table["installment"].change == 50.0
    assert table["home_ownership_RENT"].months == pytest.approx(3, abs=1)
    assert abs(table["int_rate"].t_value) > 10 > abs(table["annual_inc"].t_value)
