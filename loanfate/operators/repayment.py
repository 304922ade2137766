"""Regression of repayment time on loan terms and borrower attributes."""

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.functions import emp_bucket, home_bucket

# Fixed value: the inputs of the regression.
FORMULA = (
    "fracNumPmts ~ installment + annual_inc + dti + int_rate + revol_util"
    " + home_ownership + grade + emp_length + pred_KM"
)
# The change of each numeric input whose effect is reported.
REPORTED_CHANGE = {"installment": 50.0, "annual_inc": 10000.0, "dti": 10.0, "int_rate": 1.0, "revol_util": 10.0}


def bucket_categories(loans: DataFrame) -> DataFrame:
    """Group employment length and ownership, before incomplete rows are dropped."""
    return loans.withColumns({
        "emp_length": emp_bucket("emp_length"),
        "home_ownership": home_bucket("home_ownership"),
    })


def repayment_design(loans: DataFrame, term: int = 60, formula: str = FORMULA) -> DataFrame:
    """Design vectors of repaid loans of one term; each category leaves out its rarest level."""
    repaid = loans.filter((F.col("loan_status") == 0) & (F.col("term2") == term))
    return RFormula(formula=formula, featuresCol="features", labelCol="label").fit(repaid).transform(repaid)


def fit_repayment_ols(design: DataFrame):
    """Least squares by normal equations: one pass that adds up a small matrix."""
    training = design.select("label", "features")
    return LinearRegression(labelCol="label", featuresCol="features", maxIter=10, solver="normal").fit(training)


def feature_names(design: DataFrame) -> list[str]:
    """Names of the design columns in vector order, from the column's metadata."""
    groups = design.schema["features"].metadata["ml_attr"]["attrs"].values()
    attributes = sorted((a for group in groups for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in attributes]


def effect_table(model, design: DataFrame, term: int = 60) -> DataFrame:
    """Months by which repayment moves per reported change of each input, with t values."""
    t_values = list(model.summary.tValues)
    rows = []
    for name, coefficient, t_value in zip(feature_names(design), model.coefficients, t_values):
        change = REPORTED_CHANGE.get(name, 1.0)
        rows.append((name, change, float(coefficient), float(change * term * coefficient), float(t_value)))
    return design.sparkSession.createDataFrame(
        rows, "feature string, change double, coefficient double, months double, t_value double"
    )
