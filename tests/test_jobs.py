"""The jobs from raw CSV files to result files."""

import pytest

from loanfate import jobs
from loanfate.plans.loan_view import loans_raw, zip_base
from loanfate.sources import read_result, write_result

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    # Descriptions of these tables hold line breaks, so the file is written with quotes throughout.
    raw = loans_raw(spark, SF_DIR).withColumnRenamed("loan_id", "id")
    raw.repartition(1).write.options(header=True, quoteAll=True, escape='"').csv(f"{folder}/loans")
    write_result(zip_base(spark, SF_DIR), f"{folder}/zips")
    return str(folder)


def run(spark, files, *argv):
    jobs.main([*argv], spark)


def rows(spark, path, **columns):
    return read_result(spark, path, columns).collect()


def test_tables(spark, files):
    loans = ["--loans", f"{files}/loans", "--multi-line"]
    run(spark, files, "grades", *loans, "--keep", "all", "--out", f"{files}/grades")
    assert [r.grade for r in rows(spark, f"{files}/grades", grade="string")] == list("ABCDEFG")

    run(spark, files, "panel", *loans, "--start", "1995-01-01", "--end", "2002-01-01", "--keep", "all", "--total", "US",
        "--out", f"{files}/panel")
    panel = rows(spark, f"{files}/panel", state="string", Period="string", Curcount="bigint")
    assert sum(r.state == "US" for r in panel) == 7

    run(spark, files, "crosswalk", "--zips", f"{files}/zips", "--out", f"{files}/crosswalk")
    run(spark, files, "counties", *loans, "--crosswalk", f"{files}/crosswalk", "--out", f"{files}/counties")
    total = sum(r.Val2map for r in rows(spark, f"{files}/counties/sum", Val2map="double"))
    amounts = loans_raw(spark, SF_DIR, ["loan_amnt"]).groupBy().sum("loan_amnt").first()[0]
    assert total == pytest.approx(amounts)  # every area of these loans is in the crosswalk
    assert rows(spark, f"{files}/counties/avg", CtyFips="string")


def test_models(spark, files):
    loans = ["--loans", f"{files}/loans", "--multi-line"]
    run(spark, files, "features", *loans, "--out", f"{files}/features")
    assert len(rows(spark, f"{files}/features", loan_id="string", pred_KM="double")) > 1000
    run(spark, files, "predict", "--table", f"{files}/features", "--learner", "linear", "--out", f"{files}/predict")
    errors = {r.target: r.mse for r in rows(spark, f"{files}/predict/errors", target="string", mse="double")}
    assert set(errors) == {"probDef", "timeDef", "probER", "timeER", "all"}
    assert len(rows(spark, f"{files}/predict/density_probER", series="string")) == 200
    run(spark, files, "predict", "--table", f"{files}/features", "--learner", "linear", "--targets", "simple",
        "--out", f"{files}/simple")
    assert len(rows(spark, f"{files}/simple/calibration", event="string")) == 3
    run(spark, files, "effects", *loans, "--out", f"{files}/effects")
    assert "int_rate" in {r.feature for r in rows(spark, f"{files}/effects", feature="string")}


def test_options_and_studies(spark, files):
    loans = ["--loans", f"{files}/loans", "--multi-line"]
    names = loans_raw(spark, SF_DIR).withColumnRenamed("loan_id", "id").columns
    run(spark, files, "panel", *loans, "--columns", *names, "--start", "1995-01-01", "--end", "2002-01-01", "--keep", "all",
        "--ratio", "--offset", "0.5", "--out", f"{files}/ratio")
    shown = rows(spark, f"{files}/ratio", ER_rate="double", Def_rate="double", er_def_ratio="double")
    told = [r for r in shown if r.ER_rate is not None]
    assert told and all(r.er_def_ratio == pytest.approx((r.ER_rate + 0.5) / (r.Def_rate + 0.5)) for r in told)

    run(spark, files, "panel", *loans, "--start", "1995-01-01", "--end", "2002-01-01", "--keep", "all", "--paid-from", "1998-01-01",
        "--paid-before", "1999-01-01", "--out", f"{files}/paid")
    paid = rows(spark, f"{files}/paid", Period="string", defcount="bigint", ERcount="bigint", Schcount="bigint")
    assert {r.Period for r in paid if r.defcount + r.ERcount + r.Schcount} == {"1998-01-01"}

    run(spark, files, "breakeven", *loans, "--out", f"{files}/breakeven")
    table = rows(spark, f"{files}/breakeven", grade="string", mean_loan_amnt="double", mean_installment="double", breakeven="double")
    assert table and all(r.breakeven == pytest.approx(r.mean_loan_amnt / r.mean_installment) for r in table)

    run(spark, files, "breakeven", *loans, "--sample", "0.0", "--out", f"{files}/none")
    assert rows(spark, f"{files}/none", grade="string") == []

    run(spark, files, "quartiles", *loans, "--out", f"{files}/quartiles")
    table = rows(spark, f"{files}/quartiles", grade="string", p25="double", p75="double")
    assert table and all(r.p25 <= r.p75 for r in table)

    run(spark, files, "crosswalk", "--zips", f"{files}/zips", "--out", f"{files}/walk")
    run(spark, files, "county-ratio", *loans, "--crosswalk", f"{files}/walk", "--out", f"{files}/county_ratio")
    assert all(r.er_def_ratio > 0 for r in rows(spark, f"{files}/county_ratio", er_def_ratio="double"))

    run(spark, files, "features", *loans, "--sample", "0.5", "--paid-from", "1998-01-01", "--out", f"{files}/half")
    half = rows(spark, f"{files}/half", loan_id="string")
    assert 0 < len(half) < 700
