"""Outcomes per state, grade or nation and period, and the series drawn from them.

One pass serves all periods. A loan touches at most two cells of the panel: the period it
was issued in and the period of its last payment. Between the two it is outstanding, which
is kept as +1 at the first and -1 at the second; a running sum over the aggregated cells
gives the outstanding count. The loan table is read once and each task sends at most one
row per group and period to the shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanfate.functions.periods import first_of_month, month_number, month_span, period_start
from loanfate.operators.clean import is_default, is_early, is_scheduled
from loanfate.schema import PANEL_SCHEMA

COUNT_MEASURES = ["defcount", "ERcount", "Schcount", "shortcount", "longcount"]
SUM_MEASURES = ["dti_sum", "dti_n", "income_sum", "income_n", "newcount"]


def period_grid(spark: SparkSession, start, end, step_months: int = 12) -> DataFrame:
    """Periods ``[period_start, period_end)`` that cover ``[start, end)``; the last may be shorter."""
    start, end = first_of_month(start), first_of_month(end)
    count = -(-month_span(start, end) // step_months)
    index = spark.range(count).select(F.col("id").cast("int").alias("period"))
    begin = period_start("period", start, step_months)
    return index.select(
        "period",
        begin.alias("period_start"),
        F.least(F.add_months(begin, step_months), F.lit(end)).alias("period_end"),
    )


def period_panel(
    loans: DataFrame,
    start,
    end,
    step_months: int = 12,
    by: str = "addr_state",
    name: str = "state",
    keep: str = "complete",
    total: str | None = None,
) -> DataFrame:
    """Outcome counts and rates, and the mix of new loans, per group and period.

    Of the loans whose last payment falls in the period: ``defcount`` defaulted, ``ERcount``
    repaid early, ``Schcount`` repaid on schedule. ``Curcount`` are loans issued before the
    period's end with a last payment at or after it. The rates are shares of these four.
    ``DTI``, ``income``, ``shortcount`` and ``longcount`` describe loans issued in the period.

    ``keep="complete"`` returns cells in which every count is positive; ``keep="all"``
    returns every period of every group, also of groups without an event in the grid.
    ``total`` adds a group of that name over all loans.
    """
    first, last = first_of_month(start), first_of_month(end)
    periods = -(-month_span(first, last) // step_months)
    cells = loan_cells(loans, first, last, step_months, periods, by, every_group=keep == "all")
    return panel_of_cells(cells, start, end, step_months, name, keep, total)


def panel_of_cells(
    cells: DataFrame, start, end, step_months: int = 12, name: str = "state", keep: str = "complete", total: str | None = None
) -> DataFrame:
    """The panel of the sums per group and period that :func:`loan_cells` makes; see :func:`period_panel`.

    ``keep="all"`` needs cells of every group.
    """
    if keep not in ("complete", "all"):
        raise ValueError(f"keep must be 'complete' or 'all', got {keep!r}")
    start, end = first_of_month(start), first_of_month(end)
    periods = -(-month_span(start, end) // step_months)
    if total is not None:
        both = F.explode(F.array(F.col("key"), F.lit(total)))
        cells = sum_cells(cells.select(both.alias("key"), *[c for c in cells.columns if c != "key"]))

    in_order = Window.partitionBy("key").orderBy("period")
    cells = cells.withColumn(
        "Curcount", F.sum("delta").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    if keep == "all":
        cells = _fill_gaps(cells, in_order, periods)

    ended = F.col("ERcount") + F.col("defcount") + F.col("Schcount") + F.col("Curcount")
    panel = cells.select(
        F.col("key").alias(name),
        period_start("period", start, step_months).cast("string").alias("Period"),
        "defcount", "ERcount", "Schcount", "Curcount",
        F.try_divide("dti_sum", "dti_n").alias("DTI"),
        F.try_divide("income_sum", "income_n").alias("income"),
        "shortcount", "longcount",
        F.try_divide("ERcount", ended).alias("ER_rate"),
        F.try_divide("defcount", ended).alias("Def_rate"),
        F.try_divide("longcount", "shortcount").alias("termRatio"),
        "newcount",
    )
    if keep == "complete":
        for c in ("defcount", "ERcount", "Schcount", "Curcount", "shortcount", "longcount", "newcount"):
            panel = panel.filter(F.col(c) > 0)
    return panel.drop("newcount")


def loan_cells(loans, start, end, step_months, periods, by, every_group=False) -> DataFrame:
    """Sums per group and period of the two events of each loan.

    With ``every_group`` a loan without an event in the grid gives an empty one, so that its
    group has a cell.
    """
    def period_of(column):
        months = month_number(column) - (start.year * 12 + start.month - 1)
        return (
            F.when(F.col(column) >= F.lit(end), periods)
            .otherwise(F.floor(months / step_months).cast("int"))
        )

    placed = loans.select(
        F.col(by).alias("key"), "term", "dti", "annual_inc", "loan_status", "fracNumPmts",
        period_of("issue_d").alias("first"), period_of("last_pymnt_d").alias("last"),
    )
    opened = F.greatest(F.col("first"), F.lit(0))
    # A loan that ends in the period it is first seen in is never outstanding at a period's end.
    spans = (F.col("first").isNotNull() & (F.greatest(F.col("last"), F.lit(0)) > opened)).cast("long")
    is_new = F.col("first") >= 0
    none = F.lit(0).cast("long")

    issued = F.struct(
        opened.alias("period"), spans.alias("delta"), is_new.alias("issued"), F.lit(False).alias("closed"),
    )
    closed = F.struct(
        F.col("last").alias("period"), (none - spans).alias("delta"), F.lit(False).alias("issued"),
        F.lit(True).alias("closed"),
    )
    def in_grid(period):
        return F.coalesce((period >= 0) & (period < periods), F.lit(False))

    found = [F.when(in_grid(opened), issued), F.when(in_grid(F.col("last")), closed)]
    if every_group:
        empty = F.struct(
            F.lit(0).alias("period"), none.alias("delta"), F.lit(False).alias("issued"), F.lit(False).alias("closed"),
        )
        found.append(F.when(~in_grid(opened) & ~in_grid(F.col("last")), empty))
    events = placed.select("*", F.inline(F.array_compact(F.array(*found))))

    new_loan, over = F.col("issued"), F.col("closed")
    return events.groupBy("key", "period").agg(
        F.sum("delta").alias("delta"),
        F.count_if(over & is_default()).alias("defcount"),
        F.count_if(over & is_early()).alias("ERcount"),
        F.count_if(over & is_scheduled()).alias("Schcount"),
        F.count_if(new_loan & (F.col("term") == "36")).alias("shortcount"),
        F.count_if(new_loan & (F.col("term") == "60")).alias("longcount"),
        F.sum(F.when(new_loan, F.col("dti"))).alias("dti_sum"),
        F.count(F.when(new_loan, F.col("dti"))).alias("dti_n"),
        F.sum(F.when(new_loan, F.col("annual_inc"))).alias("income_sum"),
        F.count(F.when(new_loan, F.col("annual_inc"))).alias("income_n"),
        F.count_if(new_loan).alias("newcount"),
    )


def sum_cells(cells: DataFrame) -> DataFrame:
    measures = ["delta", *COUNT_MEASURES, *SUM_MEASURES]
    return cells.groupBy("key", "period").agg(*[F.sum(m).alias(m) for m in measures])


def _fill_gaps(cells: DataFrame, in_order, periods: int) -> DataFrame:
    """Add the periods in which a group has no event.

    Each row also stands for the empty periods up to the group's next row, and the first
    row for those before it. Only the outstanding count carries over.
    """
    following = F.coalesce(F.lead("period").over(in_order), F.lit(periods))
    is_first = F.lag("period").over(in_order).isNull()
    spread = cells.withColumns({"_next": following, "_first": is_first}).withColumn(
        "_at",
        F.explode(F.sequence(F.when(F.col("_first"), F.lit(0)).otherwise(F.col("period")), F.col("_next") - 1)),
    )
    here = F.col("_at") == F.col("period")
    counts = [F.when(here, F.col(m)).otherwise(F.lit(0)).alias(m) for m in COUNT_MEASURES + ["newcount"]]
    sums = [F.when(here, F.col(m)).alias(m) for m in SUM_MEASURES if m != "newcount"]
    outstanding = F.when(F.col("_at") >= F.col("period"), F.col("Curcount")).otherwise(F.lit(0))
    return spread.select("key", F.col("_at").alias("period"), outstanding.alias("Curcount"), *counts, *sums)


def interval_matches(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, days: int = 92) -> DataFrame:
    """Rows of ``points`` beside each row of ``intervals`` whose half-open range of dates holds the point.

    Both sides are cut into buckets of ``days``: a point is in one, an interval in each that it
    touches. They meet by an equi-join on the bucket, and the dates then decide. ``days`` near
    the usual length keeps an interval in few buckets. Nulls and empty intervals match nothing.
    """
    def bucket(d: Column) -> Column:
        return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("long")

    last = F.date_sub(F.col(end), 1)
    whole = intervals.filter(F.col(start) < F.col(end))
    touched = whole.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(last))))
    placed = points.withColumn("_bucket", bucket(F.col(point)))
    held = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return placed.join(touched, "_bucket").filter(held).drop("_bucket")


def panel_of_periods(loans: DataFrame, periods: DataFrame, by: str = "addr_state", name: str = "state") -> DataFrame:
    """Outcome counts per group for periods of any shape: uneven, with gaps, or overlapping.

    ``periods`` has (period, period_start, period_end), each a half-open range of dates. The counts
    are those of :func:`period_panel`, one row per group and period with any of them; ``newcount`` are
    the loans issued in the period. Loans are first counted by group, dates and outcome, of which
    there are few however many loans there are; only those counts meet the periods, by
    :func:`interval_matches`.
    """
    facts = loans.select(
        F.col(by).alias(name), "issue_d", "last_pymnt_d", is_default().alias("d"), is_early().alias("e"), is_scheduled().alias("s")
    )
    counts = facts.groupBy(name, "issue_d", "last_pymnt_d").agg(
        F.count("*").alias("n"), F.count_if("d").alias("defcount"), F.count_if("e").alias("ERcount"), F.count_if("s").alias("Schcount")
    )
    none = F.lit(0).cast("long")
    outcomes = ["defcount", "ERcount", "Schcount"]
    ended = interval_matches(counts, "last_pymnt_d", periods, "period_start", "period_end").select(
        name, "period", *outcomes, none.alias("Curcount"), none.alias("newcount"))
    issued = interval_matches(counts, "issue_d", periods, "period_start", "period_end").select(
        name, "period", *[none.alias(c) for c in outcomes], none.alias("Curcount"), F.col("n").alias("newcount"))
    # Outstanding at a period's end: issued before it, with the last payment at it or later.
    ends = periods.select("period", "period_end")
    running = counts.select(name, "n", F.date_add("issue_d", 1).alias("_from"), F.date_add("last_pymnt_d", 1).alias("_to"))
    held = interval_matches(ends, "period_end", running, "_from", "_to", days=366).select(
        name, "period", *[none.alias(c) for c in outcomes], F.col("n").alias("Curcount"), none.alias("newcount"))
    found = ended.unionByName(issued).unionByName(held)
    return found.groupBy(name, "period").agg(*[F.sum(c).alias(c) for c in [*outcomes, "Curcount", "newcount"]])


def append_panel(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Stack panels by column name, in the panel's column order."""
    columns = PANEL_SCHEMA.fieldNames()
    out = first.select(columns)
    for panel in more:
        out = out.unionByName(panel.select(columns))
    return out


def panel_series(panel: DataFrame, value: str, groups: list[str], name: str = "state") -> DataFrame:
    """One column per group and one row per period, for drawing a series.

    ``value`` is a panel column, or 'numLoans_issued' for short plus long loans. Rates
    become percent. The groups are given, so the pivot needs no job to find them.
    """
    source = {
        "numLoans_issued": F.col("shortcount") + F.col("longcount"),
        "ER_rate": 100 * F.col("ER_rate"),
        "Def_rate": 100 * F.col("Def_rate"),
    }.get(value, F.col(value))
    return (
        panel.filter(F.col(name).isin(groups))
        .select(F.to_date("Period").alias("Period"), name, source.alias("value"))
        .groupBy("Period").pivot(name, groups).agg(F.first("value"))
        .orderBy("Period")
    )


def top_states(loans: DataFrame, k: int = 5, by: str = "addr_state") -> DataFrame:
    """The k groups with most loans."""
    return loans.groupBy(by).count().orderBy(F.col("count").desc(), F.col(by)).limit(k)


def er_to_default_ratio(panel: DataFrame, offset: float = 0.01) -> DataFrame:
    """Early-repayment rate over default rate per row.

    ``offset`` is added to both rates so that a place without defaults does not divide by
    zero; it makes the ratio smaller than the plain one where early repayment is the rule.
    """
    ratio = F.try_divide(F.col("ER_rate") + offset, F.col("Def_rate") + offset)
    return panel.withColumn("er_def_ratio", ratio)
