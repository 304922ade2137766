"""Panels that grow with each new loan file, without reading the loans of earlier files again.

What is stored are the panel's cells (sums per group and period), the loans that may still change,
and the ids of those that have ended. A new file adds the cells of its loans. A loan that an earlier
file showed as running has new dates and an outcome now: the cells of its earlier version, made
from the stored row, are taken back. Each file is a batch of signed cells; the panel is
their sum. A batch that is written again replaces itself, so a failed update can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanfate.functions.periods import first_of_month, month_span
from loanfate.operators import panel
from loanfate.operators.panel import COUNT_MEASURES, SUM_MEASURES
from loanfate.schema import RUNNING

#: Columns of a loan that its cells depend on.
CELL_COLUMNS = ["term", "dti", "annual_inc", "loan_status", "fracNumPmts", "issue_d", "last_pymnt_d"]


def signed_cells(added: DataFrame, taken_back: DataFrame) -> DataFrame:
    """Cells of ``added`` less those of ``taken_back``, one row per group and period with any change.

    The outstanding count of a loan taken back loses its +1 and its -1, whichever periods they
    were in. A group keeps its row, with zeros, even when its last loan is taken back.
    """
    measures = ["delta", *COUNT_MEASURES, *SUM_MEASURES]
    less = taken_back.select("key", "period", *[(-F.col(m)).alias(m) for m in measures])
    return panel.sum_cells(added.select("key", "period", *measures).unionByName(less))


@dataclass(frozen=True)
class PanelStore:
    """A panel in a folder: its grid and group, and the files' batches.

    ``cells/batch=n`` are signed cells, ``open/batch=n`` the loans that may still change after
    batch n, and ``ended/batch=n`` the ids, by month of issue, of those that ended with it.
    Batches count from 0 and are added in order.
    """

    path: str
    start: str
    end: str
    step_months: int = 12
    by: str = "addr_state"
    name: str = "state"

    def add(self, loans: DataFrame, batch: int) -> None:
        """Add a file's typed loans (as :func:`clean_loans` with running ones gives them), each once.

        Loans may be new, or known and running. Ones that ended in an earlier batch are passed
        over: a file published again holds them unchanged. A known loan that the file lacks stays
        as it was. Loans without an id count as new.
        """
        spark = loans.sparkSession
        rows = loans.select("loan_id", F.col(self.by).alias("key"), *CELL_COLUMNS)
        issue_month = F.trunc("issue_d", "month")
        if batch:
            # Only the months of issue that the file holds are read of the ended ids; a file has few.
            months = [r.m for r in rows.select(issue_month.alias("m")).distinct().collect()]
            kept = T.StructType([rows.schema["loan_id"], T.StructField("issue_month", T.DateType()), T.StructField("batch", T.IntegerType())])
            ended = spark.read.schema(kept).parquet(f"{self.path}/ended").filter(F.col("batch") < batch)
            ended = ended.filter(F.col("issue_month").isin(months) | F.col("issue_month").isNull())
            rows = rows.join(ended.select("loan_id"), "loan_id", "left_anti")
            known = spark.read.parquet(f"{self.path}/open/batch={batch - 1}")
            before = known.join(rows.select("loan_id"), "loan_id", "left_semi")
            unchanged = known.join(rows.select("loan_id"), "loan_id", "left_anti")
            cells = signed_cells(self._cells(rows), self._cells(before))
            still_open = rows.filter(_may_change()).unionByName(unchanged)
        else:
            cells, still_open = self._cells(rows), rows.filter(_may_change())
        cells.write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")
        still_open.write.mode("overwrite").parquet(f"{self.path}/open/batch={batch}")
        gone = rows.filter(~_may_change()).select("loan_id", issue_month.alias("issue_month"))
        gone.hint("rebalance", "issue_month").write.mode("overwrite").partitionBy("issue_month").parquet(f"{self.path}/ended/batch={batch}")

    def cells(self, spark: SparkSession) -> DataFrame:
        """The sum of all batches, one row per group and period."""
        return panel.sum_cells(spark.read.parquet(f"{self.path}/cells"))

    def panel(self, spark: SparkSession, keep: str = "complete", total: str | None = None) -> DataFrame:
        """The panel as :func:`period_panel` gives it over the newest version of every loan."""
        return panel.panel_of_cells(
            self.cells(spark), self.start, self.end, self.step_months, self.name, keep=keep, total=total
        )

    def compact(self, spark: SparkSession, upto: int, path: str) -> PanelStore:
        """The same panel in a new folder, its batches up to ``upto`` summed into batch ``upto``."""
        cells = spark.read.parquet(f"{self.path}/cells").filter(F.col("batch") <= upto)
        panel.sum_cells(cells).write.mode("overwrite").parquet(f"{path}/cells/batch={upto}")
        spark.read.parquet(f"{self.path}/open/batch={upto}").write.mode("overwrite").parquet(f"{path}/open/batch={upto}")
        ended = spark.read.parquet(f"{self.path}/ended").filter(F.col("batch") <= upto).drop("batch")
        ended.hint("rebalance", "issue_month").write.mode("overwrite").partitionBy("issue_month").parquet(f"{path}/ended/batch={upto}")
        return PanelStore(path, self.start, self.end, self.step_months, self.by, self.name)

    def _cells(self, rows: DataFrame) -> DataFrame:
        start, end = first_of_month(self.start), first_of_month(self.end)
        periods = -(-month_span(start, end) // self.step_months)
        return panel.loan_cells(rows, start, end, self.step_months, periods, "key", every_group=True)


def _may_change() -> Column:
    """Whether a loan still runs; a repaid or written-off loan has its last payment."""
    return F.col("loan_status") == RUNNING
