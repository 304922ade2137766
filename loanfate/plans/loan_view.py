"""Loan and ZIP tables in the raw text form of the public files, derived from star-schema tables.

Orders become loans, customers borrowers, nations states, documents descriptions and parts
ZIP lines. The text columns carry the quirks of the real files: blanks and '%' signs,
unknown and prefixed statuses, missing values.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanfate.functions import select_once
from loanfate.schema import LOAN_COLUMNS

# Four loans in seven have no description, about as many as in the public data.
HAS_DESC = "o_orderkey % 7 >= 4"

_MONTH = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * ({month0}) + 1 as int), 3)"
_LAST_MONTH = "month(o_orderdate) - 1 + (o_orderkey * 7) % if(o_orderkey % 3 = 0, 64, 39)"

RAW_EXPRESSIONS = {
    "loan_id": "o_orderkey",
    "loan_amnt": "o_totalprice",
    "term": "if(o_orderkey % 3 = 0, ' 60 months', ' 36 months')",
    "int_rate": "concat(5 + (o_orderkey * 13) % 20, '.', 10 + o_orderkey % 90, '%')",
    "installment": "o_totalprice / 30.0D",
    "grade": "substring('ABCDEFG', cast(1 + o_custkey % 7 as int), 1)",
    "emp_length": """case o_custkey % 12 when 0 then 'n/a' when 1 then '< 1 year' when 2 then '1 year'
        when 11 then '10+ years' else concat(o_custkey % 12 - 1, ' years') end""",
    "home_ownership": """case c_mktsegment when 'BUILDING' then 'OWN' when 'FURNITURE' then 'MORTGAGE'
        when 'HOUSEHOLD' then 'NONE' else 'RENT' end""",
    "annual_inc": "20000.0D + abs(c_acctbal) * 12",
    "loan_status": """concat(
        if(o_orderkey % 10 = 9, 'Does not meet the credit policy. Status:', ''),
        case when o_orderkey % 10 < 5 or o_orderkey % 10 = 9 then if(o_orderkey % 20 = 9, 'Charged Off', 'Fully Paid')
            when o_orderkey % 10 = 5 then 'Charged Off'
            when o_orderkey % 10 = 6 then 'Current'
            when o_orderkey % 10 = 7 then if(o_orderkey % 20 = 7, 'Late (16-30 days)', 'Late (31-120 days)')
            else if(o_orderkey % 20 = 8, 'In Grace Period', 'Default') end)""",
    "issue_d": f"concat({_MONTH.format(month0='month(o_orderdate) - 1')}, '-', year(o_orderdate))",
    "last_pymnt_d": f"""if(o_orderkey % 101 = 0, null, concat(
        {_MONTH.format(month0=f'({_LAST_MONTH}) % 12')}, '-',
        year(o_orderdate) + cast(floor(({_LAST_MONTH}) / 12) as int)))""",
    "desc": f"if({HAS_DESC}, concat('Borrower added on 03/04/11 > ', text, '<br>'), null)",
    "dti": "if(o_orderkey % 97 = 0, null, concat((o_orderkey * 31) % 40, '.5'))",
    "revol_util": "concat((o_orderkey * 17) % 100, '.', o_orderkey % 10, '%')",
    "zip_code": "concat(lpad(c_custkey % 50, 3, '0'), 'xx')",
    "addr_state": "n_name",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loans_raw(spark: SparkSession, sf_dir: str, columns: list[str] = LOAN_COLUMNS) -> DataFrame:
    """Every order as a raw loan, with the given columns.

    Only tables that a requested column comes from are joined: each order has one customer,
    one nation and at most one document, so leaving one out loses and repeats no loan.
    """
    loans = read_table(spark, sf_dir, "orders")
    if {"home_ownership", "annual_inc", "zip_code", "addr_state"} & set(columns):
        customer = read_table(spark, sf_dir, "customer")
        loans = loans.join(customer, loans.o_custkey == customer.c_custkey)
    if "addr_state" in columns:
        nation = read_table(spark, sf_dir, "nation")
        loans = loans.join(nation, F.col("c_nationkey") == nation.n_nationkey)
    if "desc" in columns:
        documents = read_table(spark, sf_dir, "documents")
        count = documents.agg(F.count("*").alias("n")).scalar()
        # Loans without a description get keys that match nothing and differ from each
        # other, so they spread over the join's partitions instead of meeting in one.
        key = F.when(F.expr(HAS_DESC), F.col("o_orderkey") % count).otherwise(-1 - F.col("o_orderkey"))
        # Both sides grow with the data. The shuffle also spreads the text work that follows.
        texts = documents.select("doc_id", "text").hint("merge")
        loans = loans.withColumn("doc_key", key).join(texts, F.col("doc_key") == F.col("doc_id"), "left")
    return select_once(loans, [F.expr(RAW_EXPRESSIONS[c]).alias(c) for c in columns])


def zip_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a line of the ZIP to county list."""
    county = "(p_partkey % 50) * 3 + (p_partkey * p_partkey + p_size) % 7"
    return read_table(spark, sf_dir, "part").selectExpr(
        "concat(lpad(p_partkey % 50, 3, '0'), lpad((p_partkey * 7) % 100, 2, '0')) as ZIP",
        f"concat('County ', {county}) as COUNTYNAME",
        "concat('S', lpad(p_partkey % 25, 2, '0')) as STATE",
        f"lpad(10000 + {county}, 5, '0') as STCOUNTYFP",
        "case when p_partkey % 20 = 0 then 'C7' when p_partkey % 7 = 0 then 'H4' else 'H1' end as CLASSFP",
    )
