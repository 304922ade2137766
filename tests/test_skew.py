"""Hot groups: results stay right, and only partial sums of a group are shuffled."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from loanfate.functions import status_code
from loanfate.operators import counties, evaluate, features, grades, panel, summary
from loanfate.plans.loan_view import loans_raw, zip_base
from loanfate.plans.oracles import LOANS_RAW

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Nine of ten loans are of one state, grade, area and time."""
    n = 20000
    usual = F.col("id") % 10 != 0
    return spark.range(n).select(
        F.col("id").alias("loan_id"),
        F.when(usual, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 7)).alias("addr_state"),
        F.when(usual, "A").otherwise("B").alias("grade"),
        F.when(usual, "000xx").otherwise("001xx").alias("zip_code"),
        F.when(F.col("id") % 3 == 0, "60").otherwise("36").alias("term"),
        F.when(F.col("id") % 3 == 0, 60.0).otherwise(36.0).alias("term2"),
        (F.col("id") % 30).cast("double").alias("dti"), F.lit(50000.0).alias("annual_inc"),
        F.lit(100.0).alias("loan_amnt"), F.lit(10.0).alias("installment"),
        (F.col("id") % 4 == 3).cast("double").alias("loan_status"),
        F.when(usual, 0.5).otherwise((F.col("id") % 12) / 10.0).alias("fracNumPmts"),
        F.lit(dt.date(2010, 2, 15)).alias("issue_d"), F.lit(dt.date(2011, 8, 15)).alias("last_pymnt_d"),
    ).cache()


def shuffled_rows(df):
    """Rows written to shuffles, from the metrics of the finished plan."""
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        if node.nodeName() in ("Exchange",):
            metric = node.metrics().get("shuffleRecordsWritten")
            total += metric.get().value() if metric.isDefined() else 0
        inner = node.getClass().getSimpleName()
        if inner == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif inner.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_groups_are_reduced_before_the_shuffle(spark, hot):
    walk = spark.createDataFrame(
        [(2, 1, "000xx", "a", "S", "1"), (2, 1, "000xx", "b", "S", "2"), (1, 1, "001xx", "c", "S", "3")],
        "totalXX long, fipCount long, ZIPxx string, CtyNAME string, State string, CtyFips string")
    hot = hot.repartition(16).cache()
    for table in (
        grades.grade_performance(hot, keep="all"),
        panel.period_panel(hot, "2010-01-01", "2013-01-01", total="US", keep="all"),
        counties.county_sum(hot, walk),
        counties.county_outcome_rates(hot, walk),
        summary.category_counts(hot, "addr_state"),
        summary.grid_quantiles(hot, "fracNumPmts", by=("grade",)),
        features.outcome_stats(hot),
        evaluate.event_time_density(hot.select(F.lit("s").alias("series"), F.col("fracNumPmts").alias("time"))),
    ):
        moved = shuffled_rows(table)
        assert 0 < moved < 5000, table.columns


def test_hot_results(hot):
    row = grades.grade_performance(hot, keep="all").filter("grade = 'A'").first()
    assert row.def36mean == pytest.approx(
        hot.filter("grade = 'A' and term2 = 36").agg(F.avg("loan_status")).first()[0])
    cells = {(r.state, r.Period): r for r in panel.period_panel(hot, "2010-01-01", "2012-01-01", keep="all").collect()}
    assert cells["HOT", "2010-01-01"].Curcount == 18000 and cells["HOT", "2011-01-01"].Curcount == 0


def test_loans_without_description_do_not_share_a_join_key(spark):
    raw = loans_raw(spark, SF_DIR, ["loan_id", "desc"])
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    assert raw.count() == orders.count()
    joins = re.findall(r"SortMergeJoin \[(\w+)#", raw._jdf.queryExecution().executedPlan().toString())
    assert joins == ["doc_key"]
    described = raw.filter("desc is not null")
    assert described.count() == orders.filter("o_orderkey % 7 >= 4").count()
    assert described.filter("desc like '%<br>'").count() == described.count()


def test_whole_tables_are_read(spark):
    assert "LIMIT" not in LOANS_RAW.upper().split()
    assert zip_base(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/part.parquet").count()


def test_status_rule_against_the_text_patterns(spark):
    heads = ["", "Does not meet the credit policy. Status:", " ", "x"]
    # Status texts, and below them the patterns of the rule.
    tails = ["Fully Paid", "Charged Off", "Current", "Late (16-30 days)", "Late (31-120 days)", "In Grace Period",
             " In Grace Period", "Default", "Paid", "Off", "Currently", "Paid off", "0", "2"]
    texts = [h + t for h in heads for t in tails]

    def rule(value):
        for pattern, code in ((r".*Paid$", "0"), (r".*Off$", "1"), (r"(.*Current$)|( In Grace Period)", "2"),
                              (r"(Late \(16-30 days\))|(Late \(31-120 days\))", "2")):
            value = re.sub(pattern, code, value)
        try:
            return float(value)
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = {r.v: r.code for r in rows.select("v", status_code("v", True).alias("code")).collect()}
    assert got == {t: rule(t) for t in texts}


@pytest.fixture
def conf(spark):
    saved = {}

    def put(name, value):
        saved[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)

    yield put
    for name, value in saved.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_borrower_is_split_in_the_join(spark, conf, tmp_path):
    """One customer holds a third of all orders; neither side is broadcast."""
    source = "/root/testdata/sf0.01"
    for name in ("customer", "nation", "documents"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{source}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")))
    hot.repartition(8).write.parquet(f"{tmp_path}/orders.parquet")

    columns = ["loan_id", "loan_amnt", "zip_code", "addr_state"]
    expected = {tuple(r) for r in loans_raw(spark, str(tmp_path), columns).collect()}
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8KB")
    conf("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    joined = loans_raw(spark, str(tmp_path), columns)
    assert {tuple(r) for r in joined.collect()} == expected and len(expected) == orders.count()
    assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
