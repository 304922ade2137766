"""Quantiles and distinct counts from sketches that are stored per group and merged later.

A sketch has a bounded size whatever number of values it saw, and sketches of periods, files or
regions merge into that of all of them without reading a value again. Quantiles come from KLL
sketches, distinct counts from HyperLogLog ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch and the rank error that it is trusted with, in shares of the rows.
KLL_SIZE, RANK_ERROR = 800, 0.01
#: Buckets of a distinct count (a power of two) and the relative error that it is trusted with.
HLL_LOG, COUNT_ERROR = 14, 0.04


def sketch_groups(
    df: DataFrame, by: list[str], quantiles: list[str] = (), distincts: list[str] = (), size: int = KLL_SIZE, log_buckets: int = HLL_LOG
) -> DataFrame:
    """One row per group: rows ``n``, a quantile sketch ``{c}_kll`` and a distinct sketch ``{c}_hll`` per column.

    One pass with map-side partial sketches, so a group with a third of all rows sends one row
    of bounded size per task. Nulls are not counted; a group of nulls only has an empty sketch.
    Distinct values are told apart by their text.
    """
    parts = [F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(f"{c}_kll") for c in quantiles]
    parts += [F.hll_sketch_agg(F.col(c).cast("string"), log_buckets).alias(f"{c}_hll") for c in distincts]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *parts)


def merge_groups(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of :func:`sketch_groups` merged into coarser groups; an empty list merges all."""
    parts = []
    for c in sketches.columns:
        if c.endswith("_kll"):
            parts.append(F.kll_merge_agg_double(c).alias(c))
        elif c.endswith("_hll"):
            parts.append(F.hll_union_agg(c).alias(c))
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *parts)


def quantile(column: str, share: float) -> Column:
    """The value of rank ``share`` in the sketch of a column; null for an empty sketch."""
    sketch = F.col(f"{column}_kll")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def sketched_quantiles(sketches: DataFrame, columns: list[str], by: list[str], probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row per group with ``{column}_p25`` and so on."""
    return sketches.select(*by, "n", *[quantile(c, p).alias(f"{c}_p{round(100 * p)}") for c in columns for p in probabilities])


def sketched_distincts(sketches: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per group with the estimated number of different values of each column."""
    return sketches.select(*by, *[F.hll_sketch_estimate(f"{c}_hll").alias(c) for c in columns])


def rank_shares(df: DataFrame, marks: DataFrame, by: list[str], column: str, mark: str) -> DataFrame:
    """For each row of ``marks`` the shares of its group's values below ``mark`` and up to it.

    ``marks`` has a few rows per group; groups with a great many rows are pre-aggregated by task.
    """
    keys = [c for c in marks.columns]
    met = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_value")).join(marks, by)
    return met.groupBy(*keys).agg(
        F.avg((F.col("_value") < F.col(mark)).cast("double")).alias("below"),
        F.avg((F.col("_value") <= F.col(mark)).cast("double")).alias("upto"),
    )
