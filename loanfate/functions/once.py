"""Evaluate a set of expressions exactly once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Like ``df.select(*columns)``, but later filters read the results.

    The optimizer moves a filter below a projection by repeating the projected expression
    inside the filter. Where that expression parses text, a few conditions on cleaned
    columns parse the same text a dozen times per row. A one-row generator stops this.
    All given columns are computed, so give only those that are needed.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))
