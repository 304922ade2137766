"""Turn the raw text of a loan file into typed values.

All expressions are built-in Spark functions, so a whole cleaning pass stays in one
generated stage. Text that cannot be read becomes null instead of raising.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day that stands for each month of a 'Mon-YYYY' date.
MONTH_ANCHORS = {
    "Jan": "01-01", "Feb": "02-15", "Mar": "03-15", "Apr": "04-15", "May": "05-15", "Jun": "06-15",
    "Jul": "07-15", "Aug": "08-15", "Sep": "09-15", "Oct": "10-15", "Nov": "11-15", "Dec": "12-31",
}

# Status texts and their codes.
REPAID, DEFAULTED, OUTSTANDING = 0.0, 1.0, 2.0
LATE_STATUSES = ["Late (16-30 days)", "Late (31-120 days)"]
GRACE_PATTERN = r"^ +In Grace Period *$"  # the blank in front is part of the rule

# Employment and ownership groups.
UNDER_ONE_YEAR, ONE_TO_FOUR, FIVE_TO_NINE = "< 1 yr", "1-4 years", "5-9 years"

# Fixed value: markup that the lender's site adds to a description: 'Borrower added on 03/04/11 >', <br> and <br/>.
# The class in front lets a search pass over all other characters without trying each form.
DESC_MARKUP = r"[<B](?:(?<=<)br/?>|(?<=B)orrower added on [0-9][0-9]/[0-9][0-9]/[0-9][0-9] >)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_code(c, with_current: bool = False) -> Column:
    """0 repaid, 1 charged off, and 2 still running when ``with_current``; anything else null.

    A 'does not meet the credit policy' prefix does not matter: only the end of the text
    counts. Codes that are already numeric pass through.
    """
    c = _col(c)
    code = F.when(c.endswith("Paid"), F.lit(REPAID)).when(c.endswith("Off"), F.lit(DEFAULTED))
    if with_current:
        running = c.endswith("Current") | F.trim(c).isin(LATE_STATUSES) | c.rlike(GRACE_PATTERN)
        code = code.when(running, F.lit(OUTSTANDING))
    return code.otherwise(c.try_cast("double"))


def pct_to_double(c) -> Column:
    """'13.53%' -> 13.53."""
    return F.replace(_col(c), F.lit("%"), F.lit("")).try_cast("double")


def term_months(c) -> Column:
    """' 36 months' -> '36'."""
    return F.replace(F.replace(_col(c), F.lit("months"), F.lit("")), F.lit(" "), F.lit(""))


def emp_bucket(c) -> Column:
    """Employment length in four groups; an unknown length counts as under one year."""
    c = _col(c)
    return (
        F.when(c.isNull() | c.isin("n/a", "< 1 year"), F.lit(UNDER_ONE_YEAR))
        .when(c.isin("1 year", "2 years", "3 years", "4 years"), F.lit(ONE_TO_FOUR))
        .when(c.isin("5 years", "6 years", "7 years", "8 years", "9 years"), F.lit(FIVE_TO_NINE))
        .otherwise(c)
    )


def home_bucket(c) -> Column:
    """Ownership with NONE and unknown counted as OWN."""
    c = _col(c)
    return F.when(c.isNull() | (c == "NONE"), F.lit("OWN")).otherwise(c)


def mon_yyyy_to_date(c) -> Column:
    """'Dec-2011' -> 2011-12-31, with the fixed day of each month.

    Builds an ISO text and casts it, which needs no date formatter per row. The lookup is
    one constant map; twelve branches would bloat the generated code of every later step.
    """
    c = _col(c)
    anchors = F.expr("map({})".format(", ".join(f"'{m}-', '-{day}'" for m, day in MONTH_ANCHORS.items())))
    return F.concat(F.substring(c, 5, 10), anchors[F.substring(c, 1, 4)]).try_cast("date")


def clean_desc(c) -> Column:
    """Description without the site's markup; a missing one becomes 'none'."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("none")), DESC_MARKUP, "")
