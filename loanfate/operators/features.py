"""The feature table: indexed categories, event targets and counterfactual times."""

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.functions import hash_uniform
from loanfate.operators.clean import add_features, is_default, is_early, is_scheduled
from loanfate.schema import ALL_TARGETS, CATEGORY_FEATURES, NUMERIC_FEATURES
from loanfate.sources import staged


def index_categories(loans: DataFrame, columns: list[str], suffix: str = "Idx") -> DataFrame:
    """Add an index per category column: 0 for the most frequent level, ties by level.

    One fit for all columns. Rows that miss a category are dropped here, as they are by
    every user of the table; frequencies are those of all rows given.
    """
    indexer = StringIndexer(
        inputCols=columns, outputCols=[f"{c}{suffix}" for c in columns],
        stringOrderType="frequencyDesc", handleInvalid="skip",
    )
    return indexer.fit(loans).transform(loans)


def category_index(loans: DataFrame, columns: list[str]) -> DataFrame:
    """The levels of each category column with their index and number of rows."""
    indexed = index_categories(loans, columns)
    levels = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("level"), F.col(f"{c}Idx").alias("idx")) for c in columns
    ])
    return indexed.select(F.inline(levels)).groupBy("column", "level", "idx").count()


def level_index(df: DataFrame, column: str) -> DataFrame:
    """(level, count, idx): every level of a column, 0 for the most frequent, ties by level, however many there are.

    The counted levels are sorted by range over the tasks, and a level's index is its place in its
    task plus the levels of the tasks before. Only the tasks' sizes reach the driver, no level.
    Nulls are no level.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).count()
    ordered = counts.orderBy(F.col("count").desc(), "level")
    # The place in the task is the low part of the increasing id.
    numbered = staged(ordered.withColumns({"_id": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}))
    before, total = {}, 0
    for task, n in sorted(map(tuple, numbered.groupBy("_task").count().collect())):
        before[task], total = total, total + n
    base = F.coalesce(F.get(F.array(*[F.lit(before.get(t, 0)) for t in range(max(before, default=-1) + 1)]), "_task"), F.lit(0)) if before else F.lit(0)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select("level", "count", (base + place).cast("long").alias("idx"))


def index_large_category(df: DataFrame, column: str, suffix: str = "Idx") -> DataFrame:
    """Add the :func:`level_index` of a column with any number of levels; rows without a level are dropped.

    Rows of a level that a great many have are split by adaptive execution.
    """
    levels = level_index(df, column).select(F.col("level").alias(column), F.col("idx").cast("double").alias(f"{column}{suffix}"))
    return df.join(levels, column).select(*df.columns, f"{column}{suffix}")


def add_targets(loans: DataFrame, resolved_only: bool = False) -> DataFrame:
    """Event indicators ``probDef`` and ``probER``.

    Loans without a known end count as neither event. ``resolved_only`` drops them.
    """
    if resolved_only:
        loans = loans.filter(F.col("loan_status").isin(0, 1))
    return loans.withColumns({
        "probDef": F.when(is_default(), 1.0).otherwise(0.0),
        "probER": F.when(is_early(), 1.0).otherwise(0.0),
    })


def outcome_stats(loans: DataFrame) -> DataFrame:
    """One row: frequency and mean time of each event, and the two draw thresholds.

    ``threshold_not_er`` is the share of defaults among loans that defaulted or ended on
    schedule; ``threshold_not_def`` the share of early repayment among loans that were
    repaid. Defaults after the end of the term are left out.
    """
    defaulted = is_default() & (F.col("fracNumPmts") < 1)
    stats = loans.agg(
        F.avg(F.when(defaulted, F.col("fracNumPmts"))).alias("avg_def_time"),
        F.count_if(defaulted).alias("def_count"),
        F.avg(F.when(is_early(), F.col("fracNumPmts"))).alias("avg_er_time"),
        F.count_if(is_early()).alias("er_count"),
        F.count_if(is_scheduled()).alias("on_time_count"),
    )
    def share(event):
        return F.try_divide(F.col(event), F.col(event) + F.col("on_time_count"))

    return stats.withColumns({"threshold_not_er": share("def_count"), "threshold_not_def": share("er_count")})


def counterfactual_times(loans: DataFrame, key: str = "loan_id", seed: int = 7) -> DataFrame:
    """Event times ``timeDef`` and ``timeER``, drawn where the event did not happen.

    A loan that did not default gets the mean early-repayment time or 1 (the full term),
    with the odds seen among repaid loans; one that was not repaid early gets the mean
    default time or 1. The same draw decides both.

    The statistics are scalar subqueries: they are computed inside the query, over one
    shared aggregate, and never come to the driver program. They read the loans a first
    time, so give stored or staged loans rather than the plan that parses them.
    """
    stats = outcome_stats(loans)
    loans = loans if "probDef" in loans.columns else add_targets(loans)

    def draw(threshold, event_time):
        full_term = F.col("rand") > stats.select(threshold).scalar()
        return F.when(full_term, 1.0).otherwise(stats.select(event_time).scalar())

    return (
        loans.withColumn("rand", hash_uniform(key, seed))
        .withColumns({
            "randTimeNotDef": draw("threshold_not_def", "avg_er_time"),
            "randTimeNotER": draw("threshold_not_er", "avg_def_time"),
        })
        .withColumns({
            "timeDef": F.col("probDef") * F.col("fracNumPmts") + F.col("randTimeNotDef") * (1 - F.col("probDef")),
            "timeER": F.col("probER") * F.col("fracNumPmts") + F.col("randTimeNotER") * (1 - F.col("probER")),
        })
    )


def model_table(
    loans: DataFrame,
    categories: list[str] | None = None,
    key: str = "loan_id",
    resolved_only: bool = False,
) -> DataFrame:
    """Complete rows of features and targets, keyed by loan.

    Categories are replaced by their index. ``pred_KM`` is used when the loans carry it,
    that is after :func:`loanfate.operators.text.cluster_desc`. The loans are read three
    times (index, statistics, rows), so they too should be stored or staged.
    """
    if categories is None:
        categories = [c for c in CATEGORY_FEATURES if c in loans.columns]
    loans = add_targets(add_features(loans), resolved_only)
    timed = counterfactual_times(loans, key)
    indexed = index_categories(timed, categories)
    table = indexed.select(
        key,
        *NUMERIC_FEATURES,
        *[F.col(f"{c}Idx").alias(c) for c in categories],
        *ALL_TARGETS,
    )
    return table.na.drop("any", subset=[c for c in table.columns if c != key])
