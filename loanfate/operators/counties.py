"""3-digit ZIP areas: the crosswalk to counties and the allocation of loan values.

The public loan data show only the first three digits of a ZIP code. Such an area spans
several counties; a county's share of it is the share of the area's ZIP codes it holds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanfate.operators.clean import is_default, is_early


def zip_area() -> Column:
    """'78701' -> '787xx', in the lower case of the loan data."""
    return F.concat(F.substring("ZIP", 1, 3), F.lit("xx"))


def build_crosswalk(zip_base: DataFrame) -> DataFrame:
    """Per area and county: ZIP lines of the area in the county, and of the area in all.

    The class code plays no part. The window runs over counted rows, of which an area has
    as many as counties, not over ZIP lines.
    """
    counted = zip_base.groupBy(
        zip_area().alias("ZIPxx"),
        F.col("COUNTYNAME").alias("CtyNAME"),
        F.col("STATE").alias("State"),
        F.col("STCOUNTYFP").alias("CtyFips"),
    ).agg(F.count("*").alias("fipCount"))
    total = F.sum("fipCount").over(Window.partitionBy("ZIPxx"))
    return counted.select(total.alias("totalXX"), "fipCount", "ZIPxx", "CtyNAME", "State", "CtyFips")


def zip3_county_pairs(zip_base: DataFrame) -> DataFrame:
    """Distinct pairs of area and county code."""
    return zip_base.select(zip_area().alias("ZIPxx"), F.col("STCOUNTYFP").alias("FIPS")).distinct()


def crosswalk_profile(zip_base: DataFrame) -> DataFrame:
    """Size of the crosswalk: lines, areas, and area-county pairs."""
    crosswalk = build_crosswalk(zip_base)
    return crosswalk.agg(
        F.sum("fipCount").alias("lines"),
        F.count_distinct("ZIPxx").alias("areas"),
        F.count_distinct("ZIPxx", "CtyFips").alias("pairs"),
    )


def _area_shares(areas: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Each area's row for each of its counties, with the county's share.

    Loans were reduced to one row per area before, so an area with a third of all loans is
    one row here. Both sides are small and adaptive execution picks the join by their size.
    """
    joined = areas.join(crosswalk, areas.zip_code == crosswalk.ZIPxx, "inner")
    return joined.withColumn("share", F.try_divide("fipCount", "totalXX"))


def allocate_to_counties(loans: DataFrame, crosswalk: DataFrame, value: Column) -> DataFrame:
    """Aggregate loans per area, then give each of its counties its share.

    ``value`` is an aggregate over loans, such as ``F.sum("loan_amnt")``.
    """
    areas = loans.groupBy("zip_code").agg(value.alias("area_value"))
    return _area_shares(areas, crosswalk).select(
        "zip_code", "CtyFips", "CtyNAME", "State", "share", (F.col("share") * F.col("area_value")).alias("Val2map")
    )


def county_sum(loans: DataFrame, crosswalk: DataFrame, column: str = "loan_amnt") -> DataFrame:
    """Total of a loan column per county."""
    allocated = allocate_to_counties(loans, crosswalk, F.sum(column))
    return allocated.groupBy("CtyFips").agg(F.sum("Val2map").alias("Val2map"))


def county_avg(
    loans: DataFrame, crosswalk: DataFrame, column: str = "dti", method: str = "reference"
) -> DataFrame:
    """Mean of a loan column per county.

    ``method="reference"`` averages share times area mean over the county's areas, which
    understates counties that hold small shares. ``method="weighted"`` is the mean of the
    area means weighted by the shares.
    """
    allocated = allocate_to_counties(loans, crosswalk, F.avg(column))
    if method == "reference":
        mean = F.avg("Val2map")
    elif method == "weighted":
        known = F.when(F.col("Val2map").isNotNull(), F.col("share"))
        mean = F.try_divide(F.sum("Val2map"), F.sum(known))
    else:
        raise ValueError(f"method must be 'reference' or 'weighted', got {method!r}")
    return allocated.groupBy("CtyFips").agg(mean.alias("Val2map"))


def county_outcome_rates(loans: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Share of early repaid and of defaulted loans per county.

    Loans, early repayments and defaults of an area are each allocated by the same shares.
    """
    areas = loans.groupBy("zip_code").agg(
        F.count("*").alias("loans"),
        F.count_if(is_early()).alias("early"),
        F.count_if(is_default()).alias("defaults"),
    )
    counted = _area_shares(areas, crosswalk).groupBy("CtyFips").agg(*[
        F.sum(F.col("share") * F.col(c)).alias(c) for c in ("loans", "early", "defaults")
    ])
    return counted.select(
        "CtyFips",
        F.try_divide("early", "loans").alias("ER_rate"),
        F.try_divide("defaults", "loans").alias("Def_rate"),
    )
