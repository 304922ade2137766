"""Raw loan text to typed loan facts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanfate.functions import (
    clean_desc, hash_uniform, mon_yyyy_to_date, pct_to_double, select_once, status_code, term_months,
)
from loanfate.schema import LOAN_COLUMNS


def select_loan_columns(raw: DataFrame) -> DataFrame:
    """Keep the columns that some operator uses."""
    return raw.select([c for c in LOAN_COLUMNS if c in raw.columns])


def clean_loans(raw: DataFrame, with_current: bool = False) -> DataFrame:
    """Type the raw columns that are present; each text is parsed once.

    ``with_current`` gives running loans the code 2; otherwise their status is null.
    Adds ``term2``, the term as a number, and the time from issue to last payment. Select
    the columns a study needs first: all that are present are parsed.
    """
    raw = select_loan_columns(raw)
    typed = {
        "loan_status": lambda: status_code("loan_status", with_current),
        "int_rate": lambda: pct_to_double("int_rate"),
        "revol_util": lambda: pct_to_double("revol_util"),
        "term": lambda: term_months("term"),
        "dti": lambda: F.col("dti").try_cast("double"),
        "loan_amnt": lambda: F.col("loan_amnt").try_cast("double"),
        "installment": lambda: F.col("installment").try_cast("double"),
        "annual_inc": lambda: F.col("annual_inc").try_cast("double"),
        "issue_d": lambda: mon_yyyy_to_date("issue_d"),
        "last_pymnt_d": lambda: mon_yyyy_to_date("last_pymnt_d"),
        "desc": lambda: clean_desc("desc"),
    }
    columns = [typed[c]().alias(c) if c in typed else F.col(c) for c in raw.columns]
    loans = select_once(raw, columns)
    if "term" in raw.columns:
        # A term of zero has no fraction of payments; such a loan is incomplete.
        loans = loans.withColumn("term2", F.nullif(F.col("term").try_cast("double"), F.lit(0.0)))
    if {"term2", "issue_d", "last_pymnt_d"} <= set(loans.columns):
        loans = add_timing(loans)
    return loans


def add_timing(loans: DataFrame) -> DataFrame:
    """Months from issue to last payment, and that time as a fraction of the term."""
    months = F.months_between("last_pymnt_d", "issue_d")
    return loans.withColumn("mnth_start2last", months).withColumn(
        "fracNumPmts", F.try_divide("mnth_start2last", "term2")
    )


def is_default() -> Column:
    return F.col("loan_status") == 1


def is_repaid() -> Column:
    return F.col("loan_status") == 0


def is_early() -> Column:
    """Repaid before the end of the term."""
    return is_repaid() & (F.col("fracNumPmts") < 1)


def is_scheduled() -> Column:
    """Repaid at the end of the term or later."""
    return is_repaid() & (F.col("fracNumPmts") >= 1)


def add_outcomes(loans: DataFrame) -> DataFrame:
    """Add the early-repayment flag ``ER`` and a name for how the loan ended."""
    return loans.withColumns({
        "ER": F.when(is_early(), 1).otherwise(0),
        "outcome": F.when(is_default(), "default")
        .when(is_early(), "early")
        .when(is_scheduled(), "scheduled")
        .when(F.col("loan_status") == 2, "current"),
    })


def add_features(loans: DataFrame) -> DataFrame:
    """Add the installment-to-income ratio."""
    return loans.withColumn("inst2inc", F.try_divide("installment", "annual_inc"))


def drop_incomplete(loans: DataFrame, fields: list[str]) -> DataFrame:
    """Drop loans that miss any of the given fields."""
    return loans.na.drop("any", subset=fields)


def row_loss_report(loans: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows each field would lose, and all of them together, in one pass.

    One row per field plus one named 'any', to look at before trusting
    :func:`drop_incomplete`.
    """
    missing = {f: F.col(f).isNull() for f in fields}
    lost = F.lit(False)
    for test in missing.values():
        lost = lost | test
    missing["any"] = lost
    counts = loans.agg(
        F.count("*").alias("rows"),
        *[F.count_if(test).alias(f"missing_{name}") for name, test in missing.items()],
    )
    per_field = F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(f"missing_{name}").alias("missing")) for name in missing
    ])
    return counts.select("rows", F.inline(per_field)).select(
        "field", "rows", "missing", (F.col("rows") - F.col("missing")).alias("kept")
    )


def in_period(loans: DataFrame, column: str, start, end) -> DataFrame:
    """Loans with ``start <= column < end``; ISO dates.

    Facts are stored by issue year, so a range of issue dates also names the directories.
    """
    chosen = (F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date"))
    if column == "issue_d" and "issue_year" in loans.columns:
        years = F.col("issue_year").between(F.year(F.lit(start).cast("date")), F.year(F.lit(end).cast("date")))
        chosen = chosen & years
    return loans.filter(chosen)


def outstanding_at(loans: DataFrame, end) -> DataFrame:
    """Loans issued before ``end`` whose last payment is at ``end`` or later, of any status."""
    end = F.lit(end).cast("date")
    return loans.filter((F.col("last_pymnt_d") >= end) & (F.col("issue_d") < end))


def sample_rows(loans: DataFrame, fraction: float, key: str = "loan_id", seed: int = 1) -> DataFrame:
    """Repeatable row sample: a loan is in or out whatever the partitioning."""
    return loans.filter(hash_uniform(key, seed) < fraction)


def sample_per_group(df: DataFrame, by: list[str], n: int, key: str = "loan_id", seed: int = 3) -> DataFrame:
    """Exactly ``n`` rows of every group, all rows of smaller ones: those whose key draws lowest.

    Equal draws are told apart by the key. Groups are counted first. A group of N rows then
    keeps those that draw below about n / N, a little more than n of them, so that the final
    ranking sees about n rows a group however large it is. Should that leave a group short, which
    ten standard deviations make all but impossible, the margin grows until none is.
    """
    drawn = df.withColumn("_draw", hash_uniform(key, seed))
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    margin = 10.0
    while True:
        share = (F.lit(n + margin * n**0.5 + 5 * margin)) / F.col("_size")
        limits = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "_size", share.alias("_share"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        low = drawn.join(limits, same).filter(F.col("_draw") < F.col("_share"))
        short = low.groupBy(*by, "_size").agg(F.count("*").alias("_low")).filter(F.col("_low") < F.least(F.lit(n), F.col("_size")))
        if short.isEmpty():
            break
        margin *= 4
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", key))
    return low.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(*df.columns)


def split_train_test(
    loans: DataFrame, train: float = 0.8, key: str = "loan_id", seed: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Repeatable random split into two complementary parts."""
    draw = hash_uniform(key, seed)
    return loans.filter(draw < train), loans.filter(draw >= train)


def preview(df: DataFrame, order_by, n: int = 20) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(order_by).limit(n)
