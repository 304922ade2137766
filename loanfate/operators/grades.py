"""Default, early repayment and their timing by credit grade.

The studies ask for many averages over different loans of the same grade. They are all
conditional aggregates of one grouping, so the loans are read once and each task sends a
handful of partial rows per grade to the shuffle, however many loans a grade has.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.operators.clean import is_default, is_early, is_repaid

TERMS = (36, 60)
# Measures per term: what is averaged, over which loans.
RATE_MEASURES = ("def", "ER")
TIME_MEASURES = ("defTime", "repTime", "ERTime")


def grade_performance(loans: DataFrame, keep: str = "complete", by: str = "grade") -> DataFrame:
    """Mean and sample sd of rates and times per grade, for 36 and 60 month loans.

    ``def`` is the share of defaults and ``ER`` the share repaid early, both over all loans
    of the term. ``defTime``, ``ERTime`` and ``repTime`` are the fraction of the term at
    which defaulted, early repaid and all repaid loans ended.

    ``keep="complete"`` returns only grades with loans in every one of these groups;
    ``keep="all"`` returns every grade, with nulls.
    """
    measures = {
        "def": (F.lit(True), F.col("loan_status")),
        "ER": (F.lit(True), F.when(is_early(), 1.0).otherwise(0.0)),
        "defTime": (is_default(), F.col("fracNumPmts")),
        "repTime": (is_repaid(), F.col("fracNumPmts")),
        "ERTime": (is_early(), F.col("fracNumPmts")),
    }
    values, aggregates, present = [], [], []
    for term in TERMS:
        of_term = F.col("term2") == term
        for name, (population, value) in measures.items():
            column = f"{name}{term}"
            values.append(F.when(of_term & population, value).alias(column))
            aggregates += [
                F.count(column).alias(f"{column}n"),
                F.avg(column).alias(f"{column}mean"),
                F.stddev_samp(column).alias(f"{column}sd"),
            ]
            present.append(F.col(f"{column}n") > 0)

    # The values are columns before they are aggregated, so that each is computed once.
    table = loans.filter(F.col("term2").isin(*TERMS)).select(by, *values).groupBy(by).agg(*aggregates)
    if keep == "complete":
        table = table.filter(reduce(and_, present))
    elif keep != "all":
        raise ValueError(f"keep must be 'complete' or 'all', got {keep!r}")
    columns = [
        f"{name}{term}{stat}"
        for name in RATE_MEASURES + TIME_MEASURES for term in TERMS for stat in ("mean", "sd")
    ]
    return table.select(by, *columns).orderBy(by)


def grade_display_table(table: DataFrame) -> DataFrame:
    """The grade table in the units people read: percent and months."""
    columns = ["grade"]
    for term in TERMS:
        rate, spread = F.col(f"def{term}mean"), F.col(f"def{term}sd")
        columns += [
            (100 * rate).alias(f"defaultPct{term}"),
            (100 * spread).alias(f"defaultPctSd{term}"),
            (100 - 100 * rate).alias(f"repayPct{term}"),
            (term * F.col(f"defTime{term}mean")).alias(f"defaultMonth{term}"),
            (term * F.col(f"defTime{term}sd")).alias(f"defaultMonthSd{term}"),
            (term * F.col(f"repTime{term}mean")).alias(f"repayMonth{term}"),
            (term * F.col(f"repTime{term}sd")).alias(f"repayMonthSd{term}"),
        ]
    return table.select(*columns)


def _repaid(loans: DataFrame, term: int) -> DataFrame:
    return loans.filter((F.col("term2") == term) & is_repaid())


def grade_means(loans: DataFrame, column: str, term: int = 60) -> DataFrame:
    """Mean of a column by grade over repaid loans of one term."""
    return _repaid(loans, term).groupBy("grade").agg(F.avg(column).alias(f"mean_{column}")).orderBy("grade")


def breakeven_installments(loans: DataFrame, term: int = 60) -> DataFrame:
    """Installments that return the principal, by grade: mean amount over mean installment."""
    return (
        _repaid(loans, term).groupBy("grade")
        .agg(F.try_divide(F.avg("loan_amnt"), F.avg("installment")).alias("breakeven"))
        .orderBy("grade")
    )


def mean_frac_by_term(loans: DataFrame) -> DataFrame:
    """Mean fraction of the term at the last payment, by term."""
    return loans.groupBy("term").agg(F.avg("fracNumPmts").alias("mean_frac")).orderBy("term")


def mean_repay_months(loans: DataFrame, term: int = 60) -> DataFrame:
    """Mean months to repayment over repaid loans of one term."""
    return _repaid(loans, term).agg((term * F.avg("fracNumPmts")).alias("mean_months"))
