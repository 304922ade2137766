"""Named queries over the star-schema tables, one or more per operator.

Every query reads its whole tables. Averages and sums are rounded at the end, because two
engines add doubles in different orders; nothing else is done for the comparison.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.functions import emp_bucket, home_bucket, status_code
from loanfate.operators import (
    clean, counties, evaluate, features, grades, models, panel, repayment, sketches, summary, text,
)
from loanfate.operators.panel_store import PanelStore
from loanfate.plans import studies
from loanfate.plans.loan_view import loans_raw, zip_base
from loanfate.schema import (
    COUNTERFACTUAL_TARGETS, GRADE_COLUMNS, PANEL_COLUMNS, PANEL_SCHEMA, REGRESSION_COLUMNS, REGRESSION_FIELDS,
    RUNNING, SIMPLE_TARGETS, TEXT_COLUMNS, TIMING_FIELDS,
)
from loanfate.sources import (
    read_crosswalk, read_facts, read_loans, read_result, scratch_path, staged, write_facts, write_loan_archives,
    write_result,
)

FACT_COLUMNS = REGRESSION_COLUMNS + ["zip_code", "addr_state"]
AMOUNT_COLUMNS = GRADE_COLUMNS + ["loan_amnt", "installment"]
CATEGORIES = ["term", "grade", "home_ownership", "emp_length"]
GRID = ("1995-01-01", "2002-01-01")
SHOWN_GRADES = ["A", "B", "C", "D", "E", "F", "G"]
SHOWN_STATES = ["NATION_1", "NATION_4", "NATION_9", "NATION_13", "NATION_22"]


def rounded(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    """Round the double columns."""
    doubles = [n for n, t in df.dtypes if t == "double" and (columns is None or n in columns)]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# Cleaning

def clean_facts(spark, d):
    return clean.clean_loans(loans_raw(spark, d, FACT_COLUMNS))


def status_codes(spark, d):
    raw = loans_raw(spark, d, ["loan_status"])
    coded = raw.select(
        "loan_status",
        status_code("loan_status").alias("ended_code"),
        status_code("loan_status", with_current=True).alias("panel_code"),
    )
    return coded.groupBy(*coded.columns).count()


def loan_timing(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS))
    return loans.select("loan_id", "issue_d", "last_pymnt_d", "mnth_start2last", "fracNumPmts")


def loan_outcomes(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS), with_current=True)
    return clean.add_outcomes(loans).groupBy("outcome", "ER").count()


def emp_buckets(spark, d):
    raw = loans_raw(spark, d, ["emp_length"])
    return raw.select("emp_length", emp_bucket("emp_length").alias("bucket")).groupBy("emp_length", "bucket").count()


def home_buckets(spark, d):
    raw = loans_raw(spark, d, ["home_ownership"])
    return (
        raw.select("home_ownership", home_bucket("home_ownership").alias("bucket"))
        .groupBy("home_ownership", "bucket").count()
    )


def inst_to_income(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, ["loan_id", "installment", "annual_inc"]))
    return clean.add_features(loans).select("loan_id", "inst2inc")


def row_loss(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, REGRESSION_COLUMNS))
    return clean.row_loss_report(loans, REGRESSION_FIELDS)


def paid_in_period(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS))
    chosen = clean.in_period(loans, "last_pymnt_d", "1998-01-01", "1999-01-01")
    return chosen.select("loan_id", "grade", "loan_status", "last_pymnt_d")


def outstanding(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, ["grade", "term", "issue_d", "last_pymnt_d"]))
    return clean.outstanding_at(loans, "1999-01-01").groupBy("grade", "term").count()


def sampled_rows(spark, d):
    return clean.sample_rows(loans_raw(spark, d, ["loan_id", "grade", "loan_status"]), 0.1)


def preview_loans(spark, d):
    return clean.preview(loans_raw(spark, d, ["loan_id", "grade", "term", "loan_status", "issue_d"]), "loan_id", 20)


# Files

def csv_round_trip(spark, d):
    path = scratch_path(spark)
    write_result(loans_raw(spark, d, FACT_COLUMNS), path)
    loans = clean.clean_loans(read_loans(spark, path))
    return loans.withColumn("loan_id", F.col("loan_id").cast("bigint"))


def result_round_trip(spark, d):
    """Every column of the grade table through a file."""
    path = scratch_path(spark)
    table = grades.grade_performance(_grade_loans(spark, d))
    write_result(table, path, single_file=True)
    return rounded(read_result(spark, path, dict(table.dtypes)), 8)


def files_merged(spark, d):
    """Two files with different columns, in different order, read as one table by name."""
    loans = loans_raw(spark, d, FACT_COLUMNS).withColumn("loan_id", F.col("loan_id").cast("string"))
    one, two = scratch_path(spark), scratch_path(spark)
    first = F.col("loan_id").cast("bigint") % 2 == 0
    write_result(loans.filter(first).drop("revol_util", "dti"), one)
    write_result(loans.filter(~first).select(*reversed(loans.columns)), two)
    merged = clean.clean_loans(read_loans(spark, [one, two]))
    return merged.withColumn("loan_id", F.col("loan_id").cast("bigint")).select(
        "loan_id", "grade", "term", "loan_amnt", "dti", "revol_util", "issue_d", "addr_state"
    )


def archives_merged(spark, d):
    """ZIP archives with different columns, in different order, some with a line of junk and a footer, read as one table."""
    loans = loans_raw(spark, d, FACT_COLUMNS).withColumn("loan_id", F.col("loan_id").cast("string"))
    folder = scratch_path(spark)
    first = F.col("loan_id").cast("bigint") % 2 == 0
    write_loan_archives(loans.filter(first).drop("revol_util", "dti"), f"{folder}/one")
    later = loans.filter(~first).select(*reversed(loans.columns))
    write_loan_archives(later, f"{folder}/two", preamble="Notes offered by prospectus", footer="Total amount funded: 1")
    merged = clean.clean_loans(read_loans(spark, folder, archives=True))
    return merged.withColumn("loan_id", F.col("loan_id").cast("bigint")).select(
        "loan_id", "grade", "term", "loan_amnt", "dti", "revol_util", "issue_d", "addr_state"
    )


def preamble_round_trip(spark, d):
    """Files whose first line is junk and whose header is line 2, with a footer."""
    path = scratch_path(spark)
    loans = loans_raw(spark, d, GRADE_COLUMNS + ["loan_amnt"]).withColumnRenamed("loan_id", "id")
    quoted = F.concat_ws(",", *[
        F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in loans.columns
    ])
    header = ",".join(f'"{c}"' for c in loans.columns)
    # A file is the lines of one partition: preamble, header, loans, footer.
    parts = loans.select(F.spark_partition_id().alias("part"), F.lit(2).alias("place"), quoted.alias("value"))
    extra = parts.select("part").distinct().select("part", F.inline(F.array(*[
        F.struct(F.lit(k).alias("place"), F.lit(line).alias("value"))
        for k, line in ((0, "Notes offered by prospectus"), (1, header), (3, "Total amount funded: 1"))
    ])))
    lines = parts.unionByName(extra).repartition("part").sortWithinPartitions("part", "place")
    lines.select("value").write.text(path)
    read = clean.clean_loans(read_loans(spark, path, skip_preamble=True, columns=loans.columns))
    return read.select(
        F.col("loan_id").cast("bigint").alias("loan_id"), "grade", "term", "loan_status", "issue_d", "last_pymnt_d", "loan_amnt"
    )


def crosswalk_round_trip(spark, d):
    path = scratch_path(spark)
    write_result(counties.build_crosswalk(zip_base(spark, d)), path)
    return read_crosswalk(spark, path)


def facts_issued_1998(spark, d):
    path = scratch_path(spark)
    write_facts(clean.clean_loans(loans_raw(spark, d, FACT_COLUMNS), with_current=True), path)
    issued = clean.in_period(read_facts(spark, path), "issue_d", "1998-01-01", "1999-01-01")
    return issued.groupBy("addr_state", "loan_status").count()


# Grades

def _grade_loans(spark, d):
    return studies.grade_loans(loans_raw(spark, d, GRADE_COLUMNS))


def _amount_loans(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, AMOUNT_COLUMNS))
    return clean.drop_incomplete(loans, ["loan_amnt", "installment", "loan_status", *TIMING_FIELDS])


def grade_performance(spark, d):
    return rounded(grades.grade_performance(_grade_loans(spark, d)), 8)


def grade_performance_all(spark, d):
    return rounded(grades.grade_performance(_grade_loans(spark, d), keep="all"), 8)


def grade_display(spark, d):
    return rounded(grades.grade_display_table(grades.grade_performance(_grade_loans(spark, d))), 6)


def grade_mean_amount(spark, d):
    return rounded(grades.grade_means(_amount_loans(spark, d), "loan_amnt"), 4)


def grade_mean_installment(spark, d):
    return rounded(grades.grade_means(_amount_loans(spark, d), "installment"), 4)


def breakeven_60(spark, d):
    return rounded(grades.breakeven_installments(_amount_loans(spark, d), 60), 8)


def breakeven_36(spark, d):
    return rounded(grades.breakeven_installments(_amount_loans(spark, d), 36), 8)


def frac_by_term(spark, d):
    return rounded(grades.mean_frac_by_term(_grade_loans(spark, d)), 8)


def mean_repay_months(spark, d):
    return rounded(grades.mean_repay_months(_grade_loans(spark, d)), 8)


def grade_counts(spark, d):
    return summary.category_counts(_grade_loans(spark, d), "grade")


def home_counts(spark, d):
    loans = studies.regression_loans(loans_raw(spark, d, REGRESSION_COLUMNS))
    return summary.category_counts(loans, "home_ownership", ascending=True)


def frac_summary(spark, d):
    columns = ["mnth_start2last", "fracNumPmts"]
    described = summary.summarize(_grade_loans(spark, d), columns)
    return rounded(described.drop("q25", "q50", "q75"), 8)


def quartile_ranks(spark, d):
    """Whether each sketched quartile lies within the stated error of its rank."""
    columns = ["mnth_start2last", "fracNumPmts"]
    loans = _grade_loans(spark, d)
    described = summary.summarize(loans, columns)
    values = loans.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns
    ])))
    marks = described.select("column", F.posexplode(F.array("q25", "q50", "q75")).alias("k", "mark"))
    # One row per column and quartile meets the values.
    met = values.join(F.broadcast(marks), "column").groupBy("column", "k").agg(
        F.avg((F.col("value") < F.col("mark")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("mark")).cast("double")).alias("upto"),
    )
    share, error = (F.col("k") + 1) / 4, 1e-4
    within = (F.col("below") <= share + error) & (F.col("upto") >= share - error)
    return met.select("column", (25 * (F.col("k") + 1)).alias("quartile"), within.alias("within_error"))


def income_quartile_ranks(spark, d):
    """Quartiles of income by grade from sketches stored per year of issue: whether each lies within the stated error."""
    loans = staged(clean.clean_loans(loans_raw(spark, d, ["grade", "annual_inc", "issue_d"])))
    yearly = staged(sketches.sketch_groups(loans.withColumn("year", F.year("issue_d")), ["grade", "year"], quantiles=["annual_inc"]))
    merged = sketches.merge_groups(yearly, ["grade"])
    quartiles = F.posexplode(F.array(*[sketches.quantile("annual_inc", p) for p in (0.25, 0.5, 0.75)])).alias("k", "mark")
    met = sketches.rank_shares(loans, merged.select("grade", quartiles), ["grade"], "annual_inc", "mark")
    share, error = (F.col("k") + 1) / 4, sketches.RANK_ERROR
    within = (F.col("below") <= share + error) & (F.col("upto") >= share - error)
    return met.select("grade", (25 * (F.col("k") + 1)).alias("quartile"), within.alias("within_error"))


def distinct_over_years(spark, d):
    """Different amounts and areas by grade, from sketches stored per year: whether each lies within the stated error."""
    loans = staged(clean.clean_loans(loans_raw(spark, d, ["grade", "loan_amnt", "zip_code", "issue_d"])))
    columns = ["loan_amnt", "zip_code"]
    yearly = staged(sketches.sketch_groups(loans.withColumn("year", F.year("issue_d")), ["grade", "year"], distincts=columns))
    counted = sketches.sketched_distincts(sketches.merge_groups(yearly, ["grade"]), columns, ["grade"])
    exact = loans.groupBy("grade").agg(F.count("*").alias("loans"), *[F.count_distinct(c).alias(f"{c}_exact") for c in columns])
    met = counted.join(exact, "grade")
    close = [(F.abs(F.col(c) - F.col(f"{c}_exact")) <= sketches.COUNT_ERROR * F.col(f"{c}_exact")).alias(f"{c}_close") for c in columns]
    return met.select("grade", "loans", *close)


def grade_samples(spark, d):
    """Exactly 50 loans of every grade."""
    loans = loans_raw(spark, d, ["loan_id", "grade", "loan_status"])
    return clean.sample_per_group(loans, ["grade"], 50)


def repay_quantiles(spark, d):
    return rounded(summary.repay_quantiles(_grade_loans(spark, d)), 8)


# Panels

def _panel_loans(spark, d):
    return studies.panel_loans(loans_raw(spark, d, PANEL_COLUMNS))


def _panel(spark, d, **options):
    return panel.period_panel(_panel_loans(spark, d), *GRID, **options)


def state_panel(spark, d):
    return rounded(_panel(spark, d), 6)


def state_panel_all(spark, d):
    return rounded(_panel(spark, d, keep="all"), 6)


def state_panel_quarterly(spark, d):
    return rounded(_panel(spark, d, step_months=3, keep="all"), 6)


def grade_panel(spark, d):
    return rounded(_panel(spark, d, by="grade", name="grade"), 6)


def panel_finer_key(spark, d):
    """Every month of one year for every state and grade, also those without a loan yet."""
    loans = _panel_loans(spark, d).withColumn("cell", F.concat_ws("|", "addr_state", "grade"))
    table = panel.period_panel(loans, "1995-01-01", "1996-01-01", step_months=1, by="cell", name="cell", keep="all")
    return rounded(table, 6)


def panel_with_us(spark, d):
    return rounded(_panel(spark, d, keep="all", total="US"), 6)


def panel_append(spark, d):
    loans = _panel_loans(spark, d)
    early = panel.period_panel(loans, "1995-01-01", "1998-01-01")
    late = panel.period_panel(loans, "1998-01-01", "2002-01-01")
    empty = spark.createDataFrame([], PANEL_SCHEMA)
    return rounded(panel.append_panel(empty, early, late), 6)


def panel_any_periods(spark, d):
    """Overlapping, uneven and empty periods with a gap between them, and one that all loans lie in."""
    rows = [("all", "1990-01-01", "2010-01-01"), ("half", "1995-03-10", "1995-09-20"), ("within", "1995-05-01", "1995-05-31"),
            ("day", "1996-01-15", "1996-01-16"), ("long", "1996-01-15", "1999-07-01"), ("empty", "1997-01-01", "1997-01-01")]
    periods = spark.createDataFrame(rows, "period string, s string, e string").select(
        "period", F.col("s").cast("date").alias("period_start"), F.col("e").cast("date").alias("period_end"))
    return panel.panel_of_periods(_panel_loans(spark, d), periods)


def panel_grown(spark, d):
    """A panel of two files: loans as they stood at the end of 1998, then new and changed ones, with some unchanged ones again."""
    loans = staged(_panel_loans(spark, d).withColumn("loan_id", F.monotonically_increasing_id()))
    cut, seen = F.lit("1999-01-01").cast("date"), F.lit("1998-12-15").cast("date")
    later = F.col("last_pymnt_d") >= cut
    earlier = loans.filter(F.col("issue_d") < cut).withColumns({
        "loan_status": F.when(later, F.lit(float(RUNNING))).otherwise(F.col("loan_status")),
        "fracNumPmts": F.when(later, F.lit(0.0)).otherwise(F.col("fracNumPmts")),
        "last_pymnt_d": F.when(later, F.greatest("issue_d", seen)).otherwise(F.col("last_pymnt_d")),
    })
    store = PanelStore(scratch_path(spark), *GRID)
    store.add(earlier, 0)
    store.add(loans.filter((F.col("issue_d") >= cut) | later | (F.col("loan_id") % 3 == 0)), 1)
    return rounded(store.panel(spark, keep="all"), 6)


def _series(spark, d, value):
    table = _panel(spark, d, keep="all", total="US")
    return rounded(panel.panel_series(table, value, SHOWN_STATES + ["US"]), 6)


def _grade_series(spark, d, value):
    table = _panel(spark, d, keep="all", by="grade", name="grade")
    return rounded(panel.panel_series(table, value, SHOWN_GRADES, name="grade"), 6)


def series_default_rate(spark, d):
    return _series(spark, d, "Def_rate")


def series_early_rate(spark, d):
    return _series(spark, d, "ER_rate")


def series_loans_issued(spark, d):
    return _series(spark, d, "numLoans_issued")


def series_term_ratio(spark, d):
    return _series(spark, d, "termRatio")


def series_dti(spark, d):
    return _series(spark, d, "DTI")


def series_income(spark, d):
    return _series(spark, d, "income")


def grade_series_default_rate(spark, d):
    return _grade_series(spark, d, "Def_rate")


def grade_series_early_rate(spark, d):
    return _grade_series(spark, d, "ER_rate")


def grade_series_term_ratio(spark, d):
    return _grade_series(spark, d, "termRatio")


def top_states(spark, d):
    return panel.top_states(_panel_loans(spark, d))


def er_default_ratio(spark, d):
    ratio = panel.er_to_default_ratio(_panel(spark, d, keep="all"))
    return rounded(ratio.select("state", "Period", "er_def_ratio"), 6)


# Crosswalk and counties

def crosswalk(spark, d):
    return counties.build_crosswalk(zip_base(spark, d))


def crosswalk_head(spark, d):
    rows = [F.col("ZIPxx").desc(), F.col("CtyFips").desc()]
    return clean.preview(counties.build_crosswalk(zip_base(spark, d)), rows, 10)


def zip3_pairs(spark, d):
    return counties.zip3_county_pairs(zip_base(spark, d))


def crosswalk_profile(spark, d):
    return counties.crosswalk_profile(zip_base(spark, d))


def class_counts(spark, d):
    return summary.category_counts(zip_base(spark, d), "CLASSFP")


def _county_inputs(spark, d):
    loans = studies.county_loans(loans_raw(spark, d, ["zip_code", "loan_amnt", "dti"]))
    return loans, counties.build_crosswalk(zip_base(spark, d))


def county_allocation(spark, d):
    allocated = counties.allocate_to_counties(*_county_inputs(spark, d), F.sum("loan_amnt"))
    return rounded(rounded(allocated, 8, ["share"]), 5, ["Val2map"])


def county_sum(spark, d):
    return rounded(counties.county_sum(*_county_inputs(spark, d)), 5)


def county_avg(spark, d):
    return rounded(counties.county_avg(*_county_inputs(spark, d)), 6)


def county_avg_weighted(spark, d):
    return rounded(counties.county_avg(*_county_inputs(spark, d), method="weighted"), 6)


def county_er_default_ratio(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS + ["zip_code"]))
    loans = clean.drop_incomplete(loans, ["loan_status", *TIMING_FIELDS])
    rates = counties.county_outcome_rates(loans, counties.build_crosswalk(zip_base(spark, d)))
    return rounded(panel.er_to_default_ratio(rates), 8)


# Feature table

def _staged_loans(spark, d):
    """Typed loans, kept: the index fit, the statistics and the rows each read them."""
    return staged(studies.feature_loans(loans_raw(spark, d, REGRESSION_COLUMNS)))


def outcome_stats(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, ["loan_status", "term", "issue_d", "last_pymnt_d"]))
    return rounded(features.outcome_stats(loans), 8)


def event_targets(spark, d):
    targets = features.add_targets(clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS)))
    return targets.select("loan_id", "probDef", "probER")


def event_targets_resolved(spark, d):
    targets = features.add_targets(clean.clean_loans(loans_raw(spark, d, GRADE_COLUMNS)), resolved_only=True)
    return targets.select("loan_id", "probDef", "probER")


def counterfactual_times(spark, d):
    times = features.counterfactual_times(_staged_loans(spark, d))
    return rounded(times.select("loan_id", "rand", "timeDef", "timeER"), 10)


def category_index(spark, d):
    return features.category_index(staged(clean.clean_loans(loans_raw(spark, d, CATEGORIES))), CATEGORIES)


def amount_index(spark, d):
    """Index of every different installment: a category as large as the table."""
    loans = clean.clean_loans(loans_raw(spark, d, ["installment"]))
    return features.level_index(loans, "installment")


def zip_index(spark, d):
    """Loans of every area by the area's index."""
    loans = staged(clean.clean_loans(loans_raw(spark, d, ["loan_id", "zip_code"])))
    return features.index_large_category(loans, "zip_code").groupBy("zip_code", F.col("zip_codeIdx").cast("bigint").alias("idx")).count()


def category_cardinality(spark, d):
    return summary.category_cardinality(clean.clean_loans(loans_raw(spark, d, CATEGORIES)), CATEGORIES)


def model_table(spark, d):
    return rounded(features.model_table(_staged_loans(spark, d), CATEGORIES), 10, ["timeDef", "timeER"])


def train_test_counts(spark, d):
    train, test = clean.split_train_test(loans_raw(spark, d, ["loan_id", "grade"]))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "grade").count()


# Text and regression

def desc_tokens(spark, d):
    tokens = text.tokenize_desc(clean.clean_loans(loans_raw(spark, d, ["loan_id", "desc"])))
    return tokens.select(
        "loan_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5")
    )


def word_vectors(spark, d):
    """Sums of the neighbours' signs for every bucket of words."""
    return text.word_vector_sums(text.tokenize_desc(clean.clean_loans(loans_raw(spark, d, ["loan_id", "desc"]))), 4)


def _clusters(spark, d):
    loans = clean.clean_loans(loans_raw(spark, d, ["loan_id", "desc"]))
    return text.cluster_desc(loans)


def desc_clusters(spark, d):
    return text.describe_text_clusters(_clusters(spark, d))


def desc_cluster_counts(spark, d):
    return summary.category_counts(text.label_clusters(_clusters(spark, d)), "pred_KM", ascending=True)


def silent_loans_by_cluster(spark, d):
    """Loans without a description all fall into the cluster of that name."""
    labelled = text.label_clusters(_clusters(spark, d))
    return labelled.filter("no_desc").groupBy("pred_KM").count()


def cluster_totals(spark, d):
    """Loans, words and silent loans over all clusters."""
    clusters = text.describe_text_clusters(_clusters(spark, d))
    silent = F.round(F.sum(F.col("no_desc_share") * F.col("loans"))).cast("bigint")
    words = F.round(F.sum(F.col("mean_words") * F.col("loans"))).cast("bigint")
    return clusters.agg(
        F.sum("loans").alias("loans"), words.alias("words"), silent.alias("silent"),
        F.count_if(F.col("label") == text.NO_DESC).alias("no_desc_clusters"),
    )


def repay_fitted_by_grade(spark, d):
    """Fitted repayment times; least squares with a grade term meets each grade's mean."""
    loans = staged(studies.regression_loans(loans_raw(spark, d, REGRESSION_COLUMNS)))
    design = repayment.repayment_design(loans, formula=repayment.FORMULA.replace(" + pred_KM", ""))
    fitted = repayment.fit_repayment_ols(design).transform(design)
    means = fitted.groupBy("grade").agg(F.count("*").alias("loans"), F.avg("prediction").alias("mean_fitted"))
    return rounded(means, 6)


def repay_effect_of_rate(spark, d):
    """Effect of the interest rate alone on the repayment time, in the effect table's form."""
    loans = staged(studies.regression_loans(loans_raw(spark, d, REGRESSION_COLUMNS)))
    design = repayment.repayment_design(loans, formula="fracNumPmts ~ int_rate")
    return rounded(repayment.effect_table(repayment.fit_repayment_ols(design), design), 6)


def repay_effects(spark, d):
    return studies.repay_effects(loans_raw(spark, d, TEXT_COLUMNS))


# Models and their evaluation

def text_model_table(spark, d):
    return studies.text_model_table(loans_raw(spark, d, TEXT_COLUMNS))


def _predicted(spark, d, targets, learner="linear"):
    table = staged(features.model_table(_staged_loans(spark, d), CATEGORIES))
    return studies.predict_targets(table, targets, learner)


def predictions_simple(spark, d):
    table = studies.text_model_table(loans_raw(spark, d, TEXT_COLUMNS))
    return studies.predict_targets(table, SIMPLE_TARGETS, "gbt")


def predictions_counterfactual(spark, d):
    table = studies.text_model_table(loans_raw(spark, d, TEXT_COLUMNS))
    return studies.predict_targets(table, COUNTERFACTUAL_TARGETS, "gbt")


def rate_line_predictions(spark, d):
    """Straight lines on the interest rate for two targets, and their predictions beside the actual values."""
    table = staged(features.model_table(_staged_loans(spark, d), CATEGORIES))
    targets = ["probDef", "probER"]
    predicted = studies.predict_targets(table, targets, "linear", numeric=["int_rate"], categories=[], penalty=0.0)
    return rounded(predicted, 6)


def one_pass_predictions(spark, d):
    """Whether the one-pass lines of all targets predict what separate fits do, to eight digits."""
    table = staged(features.model_table(_staged_loans(spark, d), CATEGORIES))
    train, test = clean.split_train_test(table)
    targets = COUNTERFACTUAL_TARGETS
    one, each = (models.fit_multi_target(train, targets, learner) for learner in ("linear", "separate"))
    both = each.transform(test)
    gaps = [F.max(F.abs(F.col(f"{t}Pred") - one.prediction(t))).alias(t) for t in targets]
    gap = both.agg(F.count("*").alias("loans"), *gaps)
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col("loans"), (F.col(t) < 1e-8).alias("same")) for t in targets])
    return gap.select(F.inline(rows))


def prediction_errors(spark, d):
    return models.mse_table(_predicted(spark, d, COUNTERFACTUAL_TARGETS), COUNTERFACTUAL_TARGETS)


def prediction_calibration(spark, d):
    return evaluate.calibration_table(_predicted(spark, d, SIMPLE_TARGETS))


def prediction_summary(spark, d):
    columns = [c for t in COUNTERFACTUAL_TARGETS for c in (t, f"{t}Pred")]
    return summary.summarize(_predicted(spark, d, COUNTERFACTUAL_TARGETS), columns)


def default_time_predictions(spark, d):
    return evaluate.event_predictions(_predicted(spark, d, COUNTERFACTUAL_TARGETS), "probDef", "timeDef")


def early_time_density(spark, d):
    times = evaluate.event_predictions(_predicted(spark, d, SIMPLE_TARGETS), "probER", "fracNumPmts")
    return evaluate.event_time_density(evaluate.stack_series(times, ["actual", "predicted"]), resolution=1 / 8192)


def _grade_mean_predictions(spark, d, targets):
    """Predictions that need no fit: each target's mean in the loan's grade, over the training part."""
    table = staged(features.model_table(_staged_loans(spark, d), CATEGORIES))
    train, test = clean.split_train_test(table)
    means = train.groupBy("grade").agg(*[F.avg(t).alias(f"{t}Pred") for t in targets])
    return test.join(means, "grade").select(*[f"{t}Pred" for t in targets], *targets)


def grade_mean_errors(spark, d):
    predictions = _grade_mean_predictions(spark, d, COUNTERFACTUAL_TARGETS)
    return rounded(models.mse_table(predictions, COUNTERFACTUAL_TARGETS), 8)


def grade_mean_calibration(spark, d):
    return rounded(evaluate.calibration_table(_grade_mean_predictions(spark, d, SIMPLE_TARGETS)), 8)


def grade_mean_default_times(spark, d):
    predictions = _grade_mean_predictions(spark, d, COUNTERFACTUAL_TARGETS)
    return rounded(evaluate.event_predictions(predictions, "probDef", "timeDef"), 10)


def event_density(spark, d):
    loans = clean.add_outcomes(_grade_loans(spark, d)).filter(F.col("outcome").isin("default", "early"))
    return rounded(evaluate.event_time_density(loans, by="outcome", value="fracNumPmts"), 6)


QUERIES = {
    "clean_loans": clean_facts,
    "status_codes": status_codes,
    "loan_timing": loan_timing,
    "loan_outcomes": loan_outcomes,
    "emp_buckets": emp_buckets,
    "home_buckets": home_buckets,
    "inst_to_income": inst_to_income,
    "row_loss": row_loss,
    "paid_in_period": paid_in_period,
    "outstanding": outstanding,
    "sampled_rows": sampled_rows,
    "preview": preview_loans,
    "csv_round_trip": csv_round_trip,
    "result_round_trip": result_round_trip,
    "files_merged": files_merged,
    "archives_merged": archives_merged,
    "preamble_round_trip": preamble_round_trip,
    "crosswalk_round_trip": crosswalk_round_trip,
    "facts_issued_1998": facts_issued_1998,
    "grade_performance": grade_performance,
    "grade_performance_all": grade_performance_all,
    "grade_display": grade_display,
    "grade_mean_amount": grade_mean_amount,
    "grade_mean_installment": grade_mean_installment,
    "breakeven_60": breakeven_60,
    "breakeven_36": breakeven_36,
    "frac_by_term": frac_by_term,
    "mean_repay_months": mean_repay_months,
    "grade_counts": grade_counts,
    "home_counts": home_counts,
    "frac_summary": frac_summary,
    "repay_quantiles": repay_quantiles,
    "quartile_ranks": quartile_ranks,
    "income_quartile_ranks": income_quartile_ranks,
    "distinct_over_years": distinct_over_years,
    "grade_samples": grade_samples,
    "state_panel": state_panel,
    "state_panel_all": state_panel_all,
    "state_panel_quarterly": state_panel_quarterly,
    "grade_panel": grade_panel,
    "panel_with_us": panel_with_us,
    "panel_finer_key": panel_finer_key,
    "panel_append": panel_append,
    "panel_grown": panel_grown,
    "panel_any_periods": panel_any_periods,
    "series_default_rate": series_default_rate,
    "series_early_rate": series_early_rate,
    "series_loans_issued": series_loans_issued,
    "series_term_ratio": series_term_ratio,
    "series_dti": series_dti,
    "series_income": series_income,
    "grade_series_default_rate": grade_series_default_rate,
    "grade_series_early_rate": grade_series_early_rate,
    "grade_series_term_ratio": grade_series_term_ratio,
    "top_states": top_states,
    "er_default_ratio": er_default_ratio,
    "crosswalk": crosswalk,
    "crosswalk_head": crosswalk_head,
    "zip3_pairs": zip3_pairs,
    "crosswalk_profile": crosswalk_profile,
    "class_counts": class_counts,
    "county_allocation": county_allocation,
    "county_sum": county_sum,
    "county_avg": county_avg,
    "county_avg_weighted": county_avg_weighted,
    "county_er_default_ratio": county_er_default_ratio,
    "outcome_stats": outcome_stats,
    "event_targets": event_targets,
    "event_targets_resolved": event_targets_resolved,
    "counterfactual_times": counterfactual_times,
    "category_index": category_index,
    "amount_index": amount_index,
    "zip_index": zip_index,
    "category_cardinality": category_cardinality,
    "model_table": model_table,
    "train_test_counts": train_test_counts,
    "desc_tokens": desc_tokens,
    "word_vectors": word_vectors,
    "desc_clusters": desc_clusters,
    "desc_cluster_counts": desc_cluster_counts,
    "cluster_totals": cluster_totals,
    "silent_loans_by_cluster": silent_loans_by_cluster,
    "repay_fitted_by_grade": repay_fitted_by_grade,
    "repay_effects": repay_effects,
    "repay_effect_of_rate": repay_effect_of_rate,
    "text_model_table": text_model_table,
    "predictions_simple": predictions_simple,
    "predictions_counterfactual": predictions_counterfactual,
    "prediction_errors": prediction_errors,
    "rate_line_predictions": rate_line_predictions,
    "one_pass_predictions": one_pass_predictions,
    "prediction_calibration": prediction_calibration,
    "prediction_summary": prediction_summary,
    "default_time_predictions": default_time_predictions,
    "early_time_density": early_time_density,
    "grade_mean_errors": grade_mean_errors,
    "grade_mean_calibration": grade_mean_calibration,
    "grade_mean_default_times": grade_mean_default_times,
    "event_density": event_density,
}
