import pytest
from pyspark.sql import functions as F

from loanfate.operators import counties, summary
from loanfate.schema import CROSSWALK_SCHEMA, ZIP_BASE_SCHEMA

AUSTIN = [("Williamson County", "48491", 6), ("Travis County", "48453", 68), ("Hays County", "48209", 4)]
CLEVELAND = [("39155", 3), ("39153", 3), ("39103", 2), ("39093", 17), ("39085", 13), ("39055", 20), ("39043", 1),
             ("39035", 7), ("39007", 21)]
# Shares of area 471xx and what 1,433,400 of loans gives each county.
INDIANA = {
    "18019": (19, 313041.37931034487), "18025": (8, 131806.89655172414), "18043": (12, 197710.3448275862),
    "18061": (18, 296565.5172413793), "18071": (1, 16475.862068965518), "18077": (3, 49427.58620689655),
    "18093": (1, 16475.862068965518), "18117": (5, 82379.31034482758), "18123": (2, 32951.724137931036),
    "18143": (7, 115331.03448275862),
}


@pytest.fixture(scope="module")
def base(spark):
    rows = []
    for county, fips, n in AUSTIN:
        rows += [(f"787{i:02d}", county, "TX", fips, "H1") for i in range(n)]
    for fips, n in CLEVELAND:
        rows += [(f"440{i:02d}", f"C{fips}", "OH", fips, "H4") for i in range(n)]
    return spark.createDataFrame(rows, ZIP_BASE_SCHEMA)


def test_crosswalk(base):
    walk = {(r.ZIPxx, r.CtyFips): r for r in counties.build_crosswalk(base).collect()}
    assert walk["787xx", "48453"].fipCount == 68 and walk["787xx", "48453"].totalXX == 78
    assert walk["440xx", "39007"].totalXX == 87
    assert counties.build_crosswalk(base).columns == CROSSWALK_SCHEMA.fieldNames()


def test_pairs_and_profile(base):
    pairs = counties.zip3_county_pairs(base.union(base))
    assert pairs.count() == 12
    profile = counties.crosswalk_profile(base).first()
    assert (profile.lines, profile.areas, profile.pairs) == (165, 2, 12)
    assert [(r.CLASSFP, r["count"]) for r in summary.category_counts(base, "CLASSFP").collect()] == [("H4", 87), ("H1", 78)]


@pytest.fixture(scope="module")
def walk(spark):
    rows = [(87, n, "471xx", f"C{fips}", "IN", fips) for fips, (n, _) in INDIANA.items()]
    rows += [(10, 10, "100xx", "New York County", "NY", "36061"), (4, 1, "472xx", "Clark", "IN", "18019"),
             (4, 3, "472xx", "Other", "IN", "18999")]
    return spark.createDataFrame(rows, CROSSWALK_SCHEMA)


def test_published_allocation(spark, walk):
    loans = spark.createDataFrame([("471xx", 1400000.0, 10.0), ("471xx", 33400.0, 20.0), ("999xx", 5.0, 1.0)],
                                  "zip_code string, loan_amnt double, dti double")
    rows = counties.allocate_to_counties(loans, walk, F.sum("loan_amnt")).collect()
    assert len(rows) == len(INDIANA)
    for r in rows:
        assert r.Val2map == pytest.approx(INDIANA[r.CtyFips][1], rel=1e-14)


def test_county_sums_conserve_the_amount_of_whole_areas(spark, walk):
    loans = spark.createDataFrame([("100xx", 100.0, 5.0), ("472xx", 40.0, 8.0), ("472xx", 60.0, 4.0)],
                                  "zip_code string, loan_amnt double, dti double")
    sums = {r.CtyFips: r.Val2map for r in counties.county_sum(loans, walk).collect()}
    assert sums == {"36061": 100.0, "18019": 25.0, "18999": 75.0}


def test_county_averages(spark, walk):
    loans = spark.createDataFrame([("471xx", 1.0, 10.0), ("472xx", 1.0, 8.0), ("472xx", 1.0, 4.0), ("100xx", 1.0, None)],
                                  "zip_code string, loan_amnt double, dti double")
    plain = {r.CtyFips: r.Val2map for r in counties.county_avg(loans, walk).collect()}
    assert plain["18019"] == pytest.approx((19 / 87 * 10 + 1 / 4 * 6) / 2)
    weighted = {r.CtyFips: r.Val2map for r in counties.county_avg(loans, walk, method="weighted").collect()}
    assert weighted["18019"] == pytest.approx((19 / 87 * 10 + 1 / 4 * 6) / (19 / 87 + 1 / 4))
    assert weighted["36061"] is None
    with pytest.raises(ValueError):
        counties.county_avg(loans, walk, method="other")


def test_county_outcome_rates(spark, walk):
    loans = spark.createDataFrame(
        [("472xx", 0.0, 0.5), ("472xx", 1.0, 0.2), ("472xx", 0.0, 1.0), ("472xx", 0.0, 0.9), ("471xx", 1.0, 0.1)],
        "zip_code string, loan_status double, fracNumPmts double")
    rates = {r.CtyFips: r for r in counties.county_outcome_rates(loans, walk).collect()}
    assert (rates["18999"].ER_rate, rates["18999"].Def_rate) == (0.5, 0.25)
    total = 4 / 4 + 19 / 87
    assert rates["18019"].Def_rate == pytest.approx((1 / 4 + 19 / 87) / total)
