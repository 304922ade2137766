"""Column expressions: text cleaning, dates and periods, repeatable draws."""

from loanfate.functions.cleaning import (
    clean_desc, emp_bucket, home_bucket, mon_yyyy_to_date, pct_to_double, status_code, term_months,
)
from loanfate.functions.draws import hash_uniform
from loanfate.functions.once import select_once
from loanfate.functions.periods import month_number, period_start

__all__ = [
    "clean_desc", "emp_bucket", "hash_uniform", "home_bucket", "mon_yyyy_to_date",
    "month_number", "pct_to_double", "period_start", "select_once", "status_code", "term_months",
]
