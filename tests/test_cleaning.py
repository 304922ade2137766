import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loanfate.functions import (
    clean_desc, emp_bucket, hash_uniform, home_bucket, mon_yyyy_to_date, pct_to_double, status_code, term_months,
)
from loanfate.functions.cleaning import DESC_MARKUP
from loanfate.operators import clean
from loanfate.schema import GRADE_FIELDS


def apply(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


def test_status_code(spark):
    texts = [
        "Fully Paid", "Charged Off", "Does not meet the credit policy. Status:Fully Paid",
        "Does not meet the credit policy. Status:Charged Off", "Current", "Late (16-30 days)",
        "Late (31-120 days)", "In Grace Period", " In Grace Period", "Default", None, "1", "",
        "Does not meet the credit policy. Status:Late (16-30 days)",
    ]
    ended = [0, 1, 0, 1, None, None, None, None, None, None, None, 1, None, None]
    running = [0, 1, 0, 1, 2, 2, 2, None, 2, None, None, 1, None, None]
    assert apply(spark, texts, status_code("v")) == ended
    assert apply(spark, texts, status_code("v", with_current=True)) == running


def test_numbers_from_text(spark):
    assert apply(spark, ["13.53%", " 7.5%", "n/a", None, ""], pct_to_double("v")) == [13.53, 7.5, None, None, None]
    assert apply(spark, [" 36 months", "60 months", "36"], term_months("v")) == ["36", "60", "36"]


def test_buckets(spark):
    texts = ["n/a", "< 1 year", "1 year", "4 years", "5 years", "9 years", "10+ years", None]
    expected = ["< 1 yr", "< 1 yr", "1-4 years", "1-4 years", "5-9 years", "5-9 years", "10+ years", "< 1 yr"]
    assert apply(spark, texts, emp_bucket("v")) == expected
    assert apply(spark, ["OWN", "NONE", None, "RENT", "ANY"], home_bucket("v")) == ["OWN", "OWN", "OWN", "RENT", "ANY"]


def test_month_dates(spark):
    texts = ["Jan-2011", "Feb-2011", "Dec-2012", "Foo-2011", "Jan-20x1", "", None, "2011-01-01", "Jan-11"]
    expected = [dt.date(2011, 1, 1), dt.date(2011, 2, 15), dt.date(2012, 12, 31)] + [None] * 6
    assert apply(spark, texts, mon_yyyy_to_date("v")) == expected


def test_description(spark):
    texts = ["Borrower added on 03/04/11 > pay off cards<br>more<br/>", None, "plain"]
    assert apply(spark, texts, clean_desc("v")) == [" pay off cardsmore", "none", "plain"]


def test_months_between(spark):
    raw = spark.createDataFrame(
        [(" 60 months", "Jan-2011", "Jun-2016"), (" 36 months", "Jan-2011", "Dec-2012"), (" 36 months", "Mar-2011", "Apr-2011"),
         ("0 months", "Mar-2011", "Apr-2011")],
        "term string, issue_d string, last_pymnt_d string",
    )
    rows = clean.clean_loans(raw).collect()
    assert [r.mnth_start2last for r in rows] == [65.4516129, 23.96774194, 1.0, 1.0]
    assert rows[0].fracNumPmts == 65.4516129 / 60
    assert rows[3].term2 is None and rows[3].fracNumPmts is None


def test_hash_uniform_is_repeatable(spark):
    ids = spark.range(2000).repartition(7)
    draws = {r.id: r.u for r in ids.select("id", hash_uniform("id", 7).alias("u")).collect()}
    for i in (0, 17, 1999):
        assert draws[i] == int(hashlib.md5(f"7-{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert 0.47 < sum(draws.values()) / 2000 < 0.53
    assert all(0 <= u < 1 for u in draws.values())


@pytest.fixture
def loans(spark):
    return spark.createDataFrame(
        [
            (1, "A", 0.0, 36.0, dt.date(2011, 1, 1), dt.date(2012, 1, 1), 0.33),
            (2, "B", 1.0, 36.0, dt.date(2011, 2, 15), dt.date(2011, 6, 15), 0.11),
            (3, None, 0.0, 36.0, dt.date(2011, 1, 1), dt.date(2014, 1, 1), 1.0),
            (4, "B", None, 60.0, dt.date(2011, 1, 1), None, None),
            (5, "C", 2.0, 60.0, dt.date(2012, 5, 15), dt.date(2013, 1, 1), 0.12),
        ],
        "loan_id long, grade string, loan_status double, term2 double, issue_d date, last_pymnt_d date, fracNumPmts double",
    )


def test_row_loss_report_matches_drop(loans):
    report = {r.field: r for r in clean.row_loss_report(loans, GRADE_FIELDS).collect()}
    assert report["grade"].missing == 1 and report["last_pymnt_d"].missing == 1
    assert report["any"].missing == 2 and report["any"].rows == 5
    assert clean.drop_incomplete(loans, GRADE_FIELDS).count() == report["any"].kept == 3


def test_outcomes(loans):
    rows = {r.loan_id: (r.ER, r.outcome) for r in clean.add_outcomes(loans).collect()}
    assert rows == {1: (1, "early"), 2: (0, "default"), 3: (0, "scheduled"), 4: (0, None), 5: (0, "current")}


def test_period_filters(loans):
    inside = clean.in_period(loans, "issue_d", "2011-01-01", "2012-01-01")
    assert {r.loan_id for r in inside.collect()} == {1, 2, 3, 4}
    assert {r.loan_id for r in clean.outstanding_at(loans, "2012-01-01").collect()} == {1, 3}


def test_split_and_sample(spark):
    ids = spark.range(5000).withColumnRenamed("id", "loan_id")
    train, test = clean.split_train_test(ids)
    assert train.intersect(test).count() == 0
    assert train.count() + test.count() == 5000
    assert 3850 < train.count() < 4150
    sampled = clean.sample_rows(ids, 0.1)
    assert 400 < sampled.count() < 600
    again = clean.sample_rows(ids.repartition(13), 0.1)
    assert sampled.exceptAll(again).count() == 0
    keyless = spark.createDataFrame([(None,)] * 3, "loan_id long")
    assert sum(part.count() for part in clean.split_train_test(keyless)) == 3


def test_preview_and_selection(loans):
    assert [r.loan_id for r in clean.preview(loans, F.col("loan_id").desc(), 2).collect()] == [5, 4]
    wide = loans.withColumn("url", F.lit("x"))
    assert "url" not in clean.select_loan_columns(wide).columns


def test_inst_to_income(spark):
    loans = spark.createDataFrame([(300.0, 60000.0), (10.0, 0.0)], "installment double, annual_inc double")
    assert [r.inst2inc for r in clean.add_features(loans).collect()] == [0.005, None]


def test_markup_is_found_as_by_plain_alternatives(spark):
    """The pattern starts with a class of first letters, so that no form is tried elsewhere."""
    plain = r"(Borrower added on [0-9][0-9]/[0-9][0-9]/[0-9][0-9] >)|<br>|<br/>"
    texts = ["Borrower added on 03/04/11 > a<br>b<br/>c", "<b<br>r>", "<br<br>/>", "Borrower added on 3/4/11 > x", "<br />",
             "Borrower Borrower added on 03/04/11 >", "BBorrower added on 03/04/11 ><", "borrower<Borrower<br", "", None]
    want = [re.sub(plain, "", "none" if t is None else t) for t in texts]
    assert apply(spark, texts, clean_desc("v")) == want
    assert DESC_MARKUP[0] == "["
