"""Column sets and schemas shared by the operators."""

from pyspark.sql import types as T

# The names of the raw loan columns that any operator uses; everything else in
# a loan file is dropped at the scan.
LOAN_COLUMNS = [
    "loan_id", "loan_amnt", "term", "int_rate", "installment", "grade", "emp_length",
    "home_ownership", "annual_inc", "loan_status", "issue_d", "last_pymnt_d", "desc",
    "dti", "revol_util", "zip_code", "addr_state",
]

# Fixed value: the code of a loan that still runs.
RUNNING = 2

# The raw columns that each study reads.
GRADE_COLUMNS = ["loan_id", "grade", "term", "loan_status", "issue_d", "last_pymnt_d"]
PANEL_COLUMNS = [
    "loan_amnt", "term", "int_rate", "grade", "annual_inc", "loan_status", "issue_d", "dti",
    "addr_state", "last_pymnt_d",
]
REGRESSION_COLUMNS = [
    "loan_id", "loan_amnt", "term", "int_rate", "installment", "grade", "emp_length", "home_ownership",
    "annual_inc", "loan_status", "issue_d", "dti", "revol_util", "last_pymnt_d",
]
TEXT_COLUMNS = REGRESSION_COLUMNS + ["desc"]

# Columns that must be present for a loan to count, one list per study. Each study drops
# incomplete rows over its own columns, so their row sets differ on purpose. The derived
# times are not listed: they are there whenever the term and both dates are.
TIMING_FIELDS = ["term2", "issue_d", "last_pymnt_d"]
GRADE_FIELDS = ["grade", "loan_status", *TIMING_FIELDS]
PANEL_FIELDS = ["loan_amnt", "int_rate", "grade", "annual_inc", "loan_status", "dti", "addr_state", *TIMING_FIELDS]
REGRESSION_FIELDS = [
    "loan_amnt", "int_rate", "installment", "grade", "emp_length", "home_ownership",
    "annual_inc", "loan_status", "dti", "revol_util", *TIMING_FIELDS,
]

# Names of the inputs and targets of the feature table.
NUMERIC_FEATURES = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_util", "installment", "inst2inc"]
CATEGORY_FEATURES = ["term", "grade", "home_ownership", "pred_KM", "emp_length"]
SIMPLE_TARGETS = ["probDef", "probER", "fracNumPmts"]
COUNTERFACTUAL_TARGETS = ["probDef", "timeDef", "probER", "timeER"]
ALL_TARGETS = ["probDef", "timeDef", "probER", "timeER", "fracNumPmts"]

# Column names of the files below. Codes stay strings: FIPS and ZIP codes have
# leading zeros.
ZIP_BASE_SCHEMA = T.StructType([
    T.StructField("ZIP", T.StringType()),
    T.StructField("COUNTYNAME", T.StringType()),
    T.StructField("STATE", T.StringType()),
    T.StructField("STCOUNTYFP", T.StringType()),
    T.StructField("CLASSFP", T.StringType()),
])
CROSSWALK_SCHEMA = T.StructType([
    T.StructField("totalXX", T.LongType()),
    T.StructField("fipCount", T.LongType()),
    T.StructField("ZIPxx", T.StringType()),
    T.StructField("CtyNAME", T.StringType()),
    T.StructField("State", T.StringType()),
    T.StructField("CtyFips", T.StringType()),
])
PANEL_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("Period", T.StringType()),
    T.StructField("defcount", T.LongType()),
    T.StructField("ERcount", T.LongType()),
    T.StructField("Schcount", T.LongType()),
    T.StructField("Curcount", T.LongType()),
    T.StructField("DTI", T.DoubleType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("shortcount", T.LongType()),
    T.StructField("longcount", T.LongType()),
    T.StructField("ER_rate", T.DoubleType()),
    T.StructField("Def_rate", T.DoubleType()),
    T.StructField("termRatio", T.DoubleType()),
])
