"""Counts, summary statistics and quantiles of any table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Rows per value, ordered by count; equal counts are ordered by value."""
    order = F.col("count").asc() if ascending else F.col("count").desc()
    return df.groupBy(column).count().orderBy(order, F.col(column))


def summarize(df: DataFrame, columns: list[str], accuracy: int = 10000) -> DataFrame:
    """Count, mean, sd, minimum, quartiles and maximum, one row per column.

    One pass for all columns. Quartiles come from a mergeable sketch of bounded size, with
    a rank error of at most 1/accuracy; :func:`grid_quantiles` is the exact way.
    """
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.count(value).alias(f"{c}|count"),
            F.avg(value).alias(f"{c}|mean"),
            F.stddev_samp(value).alias(f"{c}|stddev"),
            F.min(value).alias(f"{c}|min"),
            F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias(f"{c}|quartiles"),
            F.max(value).alias(f"{c}|max"),
        ]
    one_row = df.agg(*aggregates)

    def part(c, stat):
        return F.col(f"`{c}|{stat}`")

    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            part(c, "count").alias("count"),
            part(c, "mean").alias("mean"),
            part(c, "stddev").alias("stddev"),
            part(c, "min").alias("min"),
            part(c, "quartiles")[0].alias("q25"),
            part(c, "quartiles")[1].alias("q50"),
            part(c, "quartiles")[2].alias("q75"),
            part(c, "max").alias("max"),
        )
        for c in columns
    ])
    return one_row.select(F.inline(rows))


def grid_quantiles(
    df: DataFrame, column: str, probabilities=(0.25, 0.5, 0.75), by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact quantiles per group of a column with few different values, such as whole months.

    Equal values are counted first, by all tasks; a group then brings together one row per
    different value, however many loans it holds. Times from month to month lie on a grid of
    a few thousand values. Amounts do not: use :func:`summarize` for those. Quantiles between
    two values are interpolated.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(*[
        F.percentile(column, F.lit(float(p)), F.col("_n")).alias(f"p{round(100 * p)}") for p in probabilities
    ])


def repay_quantiles(loans: DataFrame, by: tuple[str, ...] = ("grade",), term: int = 60) -> DataFrame:
    """Quartiles of months to repayment per group, over repaid loans of one term."""
    repaid = loans.filter((F.col("term2") == term) & (F.col("loan_status") == 0))
    return grid_quantiles(repaid, "mnth_start2last", by=by).orderBy(*by)


def category_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Different levels per category column, and the embedding width they call for."""
    one_row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("levels")) for c in columns])
    width = F.least(F.lit(10), F.floor((F.col("levels") + 1) / 2))
    return one_row.select(F.inline(rows)).withColumn("embedding_width", width.cast("long"))
