"""Predictions against outcomes: calibration, event subsets and densities of event times."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event names and their columns.
EVENTS = {"Default": "probDef", "Repaid Early": "probER", "Orig. Term": "probOrig"}


def add_original_term(predictions: DataFrame) -> DataFrame:
    """Add the probability that a loan runs its original term, actual and predicted."""
    return predictions.withColumns({
        "probOrig": 1 - F.col("probDef") - F.col("probER"),
        "probOrigPred": 1 - F.col("probDefPred") - F.col("probERPred"),
    })


def calibration_table(predictions: DataFrame) -> DataFrame:
    """Mean actual and mean predicted probability per event, in percent."""
    means = add_original_term(predictions).agg(*[
        (100 * F.avg(c)).alias(c) for event in EVENTS.values() for c in (event, f"{event}Pred")
    ])
    rows = [
        F.struct(F.lit(label).alias("event"), F.col(c).alias("actual"), F.col(f"{c}Pred").alias("predicted"))
        for label, c in EVENTS.items()
    ]
    return means.select(F.inline(F.array(*rows)))


def event_predictions(predictions: DataFrame, event: str, time: str) -> DataFrame:
    """Actual and predicted time of the loans to which the event happened."""
    return predictions.filter(F.col(event) == 1.0).select(
        F.col(time).alias("actual"), F.col(f"{time}Pred").alias("predicted")
    )


def stack_series(df: DataFrame, columns: list[str], label: str = "series", value: str = "time") -> DataFrame:
    """Turn columns into rows of (series, value)."""
    rows = F.array(*[F.struct(F.lit(c).alias(label), F.col(c).alias(value)) for c in columns])
    return df.select(F.inline(rows))


def event_time_density(
    times: DataFrame, by: str = "series", value: str = "time", points: int = 100, resolution: float | None = None
) -> DataFrame:
    """Gaussian kernel density of event times on the grid 0, 1/points, ... below 1.

    The bandwidth is sd * n^(-1/5) per series. Equal times are counted first, by all tasks, and
    the kernel is summed over the counts: times from month to month are a few thousand different
    values however many loans there are, and the density is exact. Continuous times, such as
    predictions, are rounded to multiples of ``resolution`` before they are counted, which bounds
    the counts; a resolution of a fiftieth of the bandwidth changes the density by less than a
    thousandth of its peak. A series without spread, one time or equal times only, has a null density.
    """
    x = F.col(value).cast("double")
    if resolution is not None:
        x = F.round(x / F.lit(resolution)) * F.lit(resolution)
    counts = times.select(by, x.alias("_x")).filter("_x IS NOT NULL").groupBy(by, "_x").agg(F.count("*").alias("_k"))
    total, mean = F.sum("_k"), F.try_divide(F.sum(F.col("_k") * F.col("_x")), F.sum("_k"))
    moments = counts.groupBy(by).agg(total.alias("_n"), mean.alias("_mean"))
    off = F.col("_x") - F.col("_mean")
    spread = counts.join(moments, by).groupBy(by, "_n").agg(F.sum(F.col("_k") * off * off).alias("_squares"))
    width = F.sqrt(F.try_divide(F.col("_squares"), F.col("_n") - 1)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    widths = spread.select(by, "_n", F.nullif(width, F.lit(0.0)).alias("_width"))

    z = F.try_divide(F.col("_step") / F.lit(float(points)) - F.col("_x"), F.col("_width"))
    on_grid = counts.join(widths, by).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    sums = on_grid.groupBy(by, "_step", "_n", "_width").agg(F.sum(F.col("_k") * F.exp(-0.5 * z * z)).alias("_sum"))
    height = F.try_divide(F.col("_sum"), F.col("_n") * F.col("_width") * math.sqrt(2 * math.pi))
    return sums.select(by, (F.col("_step") / F.lit(float(points))).alias("x"), height.alias("density"))
