"""The loan set of each study, and the studies that chain several operators."""

from pyspark.sql import DataFrame

from loanfate.operators.clean import clean_loans, drop_incomplete, split_train_test
from loanfate.operators.features import model_table
from loanfate.operators.models import fit_multi_target, prediction_table
from loanfate.operators.repayment import bucket_categories, effect_table, fit_repayment_ols, repayment_design
from loanfate.operators.text import cluster_desc, label_clusters
from loanfate.schema import (
    GRADE_COLUMNS, GRADE_FIELDS, PANEL_COLUMNS, PANEL_FIELDS, REGRESSION_FIELDS, TEXT_COLUMNS,
)
from loanfate.sources import staged


def grade_loans(raw: DataFrame) -> DataFrame:
    """Loans that ended, with what the grade tables need."""
    return drop_incomplete(clean_loans(_present(raw, GRADE_COLUMNS)), GRADE_FIELDS)


def panel_loans(raw: DataFrame) -> DataFrame:
    """Loans that ended or are running, with what the panels need."""
    return drop_incomplete(clean_loans(_present(raw, PANEL_COLUMNS), with_current=True), PANEL_FIELDS)


def regression_loans(raw: DataFrame) -> DataFrame:
    """Loans that ended, with grouped categories and every regression input.

    The description comes along if the raw loans have it.
    """
    return drop_incomplete(bucket_categories(clean_loans(_present(raw, TEXT_COLUMNS))), REGRESSION_FIELDS)


def feature_loans(raw: DataFrame) -> DataFrame:
    """All loans, typed, with every input of the feature table."""
    return clean_loans(_present(raw, TEXT_COLUMNS))


def county_loans(raw: DataFrame) -> DataFrame:
    """Loan values to allocate; loans of any status count."""
    return clean_loans(_present(raw, ["zip_code", "loan_amnt", "dti"]))


def _present(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Cleaning parses what it is given, so each study hands it its own columns only."""
    return raw.select([c for c in columns if c in raw.columns])


def repay_effects(raw: DataFrame, **embedding) -> DataFrame:
    """Effect of each input on repayment time, with the description cluster as one of them.

    Embedding and clustering use all loans with complete data; the regression those repaid.
    The design needs several passes for its categories, so the labelled loans are staged.
    """
    labelled = staged(label_clusters(cluster_desc(regression_loans(raw), **embedding)))
    design = repayment_design(labelled)
    return effect_table(fit_repayment_ols(design), design)


def text_model_table(raw: DataFrame, chosen=None, **embedding) -> DataFrame:
    """Feature table with the description cluster as a category, staged for the fits.

    ``chosen`` narrows the typed loans first, for instance to a range of dates.
    """
    loans = feature_loans(raw)
    return staged(model_table(cluster_desc(loans if chosen is None else chosen(loans), **embedding)))


def predict_targets(table: DataFrame, targets: list[str], learner: str = "linear", **options) -> DataFrame:
    """Fit on four fifths of a feature table and predict the rest."""
    train, test = split_train_test(table)
    return prediction_table(fit_multi_target(train, targets, learner, **options), test, targets)
