"""Month arithmetic for period grids."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(d) -> Column:
    """Months since year 0, so that month differences are plain subtraction."""
    d = F.col(d) if isinstance(d, str) else d
    return F.year(d) * 12 + F.month(d) - 1


def period_start(index, start: dt.date, step_months: int) -> Column:
    """First day of the period with the given 0-based index."""
    index = F.col(index) if isinstance(index, str) else index
    return F.add_months(F.lit(start), (index * step_months).cast("int"))


def first_of_month(value) -> dt.date:
    """Read a grid boundary; grids run on whole months."""
    day = value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
    if day.day != 1:
        raise ValueError(f"period boundaries must be the first of a month, got {day}")
    return day


def month_span(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + end.month - start.month
