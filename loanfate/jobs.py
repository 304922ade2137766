"""Command-line jobs: read loan files, run a study, write its table.

spark-submit --py-files loanfate.zip loanfate/jobs.py grades --loans a.csv b.csv --skip-preamble --out out/grades
python -m loanfate.jobs panel --loans a.csv --start 2010-01-01 --end 2018-01-01 --step 3 --out out/panel
"""

import argparse

from pyspark.sql import SparkSession

from loanfate.operators import clean, counties, evaluate, grades, models, panel, summary
from loanfate.plans import studies
from loanfate.schema import (
    ALL_TARGETS, CATEGORY_FEATURES, COUNTERFACTUAL_TARGETS, NUMERIC_FEATURES, SIMPLE_TARGETS, TIMING_FIELDS,
)
from loanfate.sources import read_crosswalk, read_loans, read_result, read_zip_base, write_result

TARGETS = {"simple": SIMPLE_TARGETS, "counterfactual": COUNTERFACTUAL_TARGETS}
FEATURE_TYPES = {"loan_id": "string"} | {
    c: "double" for c in NUMERIC_FEATURES + CATEGORY_FEATURES + ALL_TARGETS
}


def _loans(spark, args):
    loans = read_loans(
        spark, args.loans, skip_preamble=args.skip_preamble, multi_line=args.multi_line, columns=args.columns
    )
    return loans if args.sample is None else clean.sample_rows(loans, args.sample)


def _paid_between(loans, args):
    """Cleaned loans whose last payment lies in the range, where one is given."""
    if args.paid_from is None and args.paid_before is None:
        return loans
    return clean.in_period(loans, "last_pymnt_d", args.paid_from or "0001-01-01", args.paid_before or "9999-12-31")


def _amount_loans(spark, args):
    loans = clean.clean_loans(_loans(spark, args).select("loan_id", "grade", "term", "loan_status", "issue_d", "last_pymnt_d",
                                                         "loan_amnt", "installment"))
    complete = clean.drop_incomplete(loans, ["loan_amnt", "installment", "loan_status", *TIMING_FIELDS])
    return _paid_between(complete, args)


def grades_job(spark, args):
    loans = _paid_between(studies.grade_loans(_loans(spark, args)), args)
    write_result(grades.grade_performance(loans, keep=args.keep), args.out, single_file=True)


def breakeven_job(spark, args):
    """Mean amounts and break-even installments by grade."""
    loans = _amount_loans(spark, args)
    means = grades.grade_means(loans, "loan_amnt", args.term).join(grades.grade_means(loans, "installment", args.term), "grade")
    table = means.join(grades.breakeven_installments(loans, args.term), "grade").orderBy("grade")
    write_result(table, args.out, single_file=True)


def quartiles_job(spark, args):
    """Quartiles of months to repayment by grade."""
    loans = _paid_between(studies.grade_loans(_loans(spark, args)), args)
    write_result(summary.repay_quantiles(loans, term=args.term), args.out, single_file=True)


def panel_job(spark, args):
    table = panel.period_panel(
        _paid_between(studies.panel_loans(_loans(spark, args)), args), args.start, args.end, args.step,
        by=args.by, name="grade" if args.by == "grade" else "state", keep=args.keep, total=args.total,
    )
    if args.ratio:
        table = panel.er_to_default_ratio(table, args.offset)
    write_result(table, args.out, single_file=True)


def crosswalk_job(spark, args):
    write_result(counties.build_crosswalk(read_zip_base(spark, args.zips)), args.out, single_file=True)


def counties_job(spark, args):
    loans, crosswalk = studies.county_loans(_loans(spark, args)), read_crosswalk(spark, args.crosswalk)
    write_result(counties.county_sum(loans, crosswalk), f"{args.out}/sum", single_file=True)
    write_result(counties.county_avg(loans, crosswalk, method=args.method), f"{args.out}/avg", single_file=True)


def county_ratio_job(spark, args):
    """Early-repayment rate over default rate by county."""
    loans = clean.clean_loans(_loans(spark, args).select("loan_id", "grade", "term", "loan_status", "issue_d", "last_pymnt_d", "zip_code"))
    loans = _paid_between(clean.drop_incomplete(loans, ["loan_status", *TIMING_FIELDS]), args)
    rates = counties.county_outcome_rates(loans, read_crosswalk(spark, args.crosswalk))
    write_result(panel.er_to_default_ratio(rates, args.offset), args.out, single_file=True)


def features_job(spark, args):
    raw = _loans(spark, args)
    write_result(studies.text_model_table(raw, chosen=lambda loans: _paid_between(loans, args)), args.out)


def effects_job(spark, args):
    write_result(studies.repay_effects(_loans(spark, args)), args.out, single_file=True)


def predict_job(spark, args):
    targets = TARGETS[args.targets]
    table = read_result(spark, args.table, FEATURE_TYPES)
    write_result(studies.predict_targets(table, targets, args.learner), f"{args.out}/predictions")
    predictions = read_result(
        spark, f"{args.out}/predictions", {c: "double" for t in targets for c in (t, f"{t}Pred")}
    )
    write_result(models.mse_table(predictions, targets), f"{args.out}/errors", single_file=True)
    write_result(evaluate.calibration_table(predictions), f"{args.out}/calibration", single_file=True)
    for event, time in (("probDef", "timeDef"), ("probER", "timeER")):
        time = time if time in targets else "fracNumPmts"
        shown = evaluate.stack_series(evaluate.event_predictions(predictions, event, time), ["actual", "predicted"])
        write_result(evaluate.event_time_density(shown), f"{args.out}/density_{event}", single_file=True)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loanfate", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name, run, reads_loans=True):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--out", required=True)
        if reads_loans:
            sub.add_argument("--loans", nargs="+", required=True)
            sub.add_argument("--skip-preamble", action="store_true")
            sub.add_argument("--multi-line", action="store_true")
            sub.add_argument("--columns", nargs="+", help="the files' column names in order: all files are one scan")
            sub.add_argument("--sample", type=float, help="share of the loans to take, by the hash of their id")
            sub.add_argument("--paid-from", help="first day of last payment")
            sub.add_argument("--paid-before", help="day after the last day of last payment")
        return sub

    job("grades", grades_job).add_argument("--keep", choices=["complete", "all"], default="complete")
    sub = job("panel", panel_job)
    sub.add_argument("--start", required=True)
    sub.add_argument("--end", required=True)
    sub.add_argument("--step", type=int, default=12, help="months per period")
    sub.add_argument("--by", choices=["addr_state", "grade"], default="addr_state")
    sub.add_argument("--keep", choices=["complete", "all"], default="complete")
    sub.add_argument("--total", help="name of an added group over all loans")
    sub.add_argument("--ratio", action="store_true", help="add the early-repayment rate over the default rate")
    sub.add_argument("--offset", type=float, default=0.01, help="added to both rates of the ratio")
    job("breakeven", breakeven_job).add_argument("--term", type=int, default=60)
    job("quartiles", quartiles_job).add_argument("--term", type=int, default=60)
    job("crosswalk", crosswalk_job, reads_loans=False).add_argument("--zips", required=True)
    sub = job("counties", counties_job)
    sub.add_argument("--crosswalk", required=True)
    sub.add_argument("--method", choices=["reference", "weighted"], default="reference")
    sub = job("county-ratio", county_ratio_job)
    sub.add_argument("--crosswalk", required=True)
    sub.add_argument("--offset", type=float, default=0.01, help="added to both rates")
    job("features", features_job)
    job("effects", effects_job)
    sub = job("predict", predict_job, reads_loans=False)
    sub.add_argument("--table", required=True)
    sub.add_argument("--targets", choices=sorted(TARGETS), default="counterfactual")
    sub.add_argument("--learner", choices=["linear", "gbt"], default="gbt")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"loanfate-{args.job}").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
