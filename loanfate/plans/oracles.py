"""SQL that computes each query's result independently, for a second engine.

The SQL takes the long way on purpose: text rules as regular expressions, one subquery per
statistic joined by key, and one range join per panel count. None of the single-pass
rewrites of the operators appear here.
"""

# The text patterns of the rules and what they are replaced by.
PAID, OFF = ("'.*Paid$'", "'0'"), ("'.*Off$'", "'1'")
RUNNING = ("'(.*Current$)|( In Grace Period)'", "'2'")
LATE = (r"'(Late \(16-30 days\))|(Late \(31-120 days\))'", "'2'")
TERM_BLANKS = ("'( months)|( )'", "''")
MARKUP = ("'(Borrower added on [0-9][0-9]/[0-9][0-9]/[0-9][0-9] >)|<br>|<br/>'", "''")
UNDER_ONE_YEAR = ("'(n/a)|(< 1 year)'", "'< 1 yr'")
ONE_TO_FOUR = ("'(1 year)|(2 years)|(3 years)|(4 years)'", "'1-4 years'")
FIVE_TO_NINE = ("'(5)|(6)|(7)|(8)|(9)'", "'5-9'")
OWNED = ("'(OWN)|(NONE)'", "'OWN'")


def _replaced(text, *rules, flags=""):
    for pattern, value in rules:
        text = f"regexp_replace({text}, {pattern}, {value}{flags})"
    return text


LOANS_RAW = """
loans_raw AS (
 SELECT o_orderkey AS loan_id,
  o_totalprice AS loan_amnt,
  CASE WHEN o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
  CAST(5 + (o_orderkey * 13) % 20 AS VARCHAR) || '.' || CAST(10 + o_orderkey % 90 AS VARCHAR) || '%' AS int_rate,
  o_totalprice / CAST(30 AS DOUBLE) AS installment,
  substr('ABCDEFG', CAST(1 + o_custkey % 7 AS INT), 1) AS grade,
  CASE o_custkey % 12 WHEN 0 THEN 'n/a' WHEN 1 THEN '< 1 year' WHEN 2 THEN '1 year' WHEN 11 THEN '10+ years'
   ELSE CAST(o_custkey % 12 - 1 AS VARCHAR) || ' years' END AS emp_length,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN' WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'FURNITURE' THEN 'MORTGAGE'
   WHEN 'HOUSEHOLD' THEN 'NONE' ELSE 'RENT' END AS home_ownership,
  CAST(20000 AS DOUBLE) + abs(c_acctbal) * 12 AS annual_inc,
  CASE WHEN o_orderkey % 10 = 9 THEN 'Does not meet the credit policy. Status:' ELSE '' END ||
  CASE WHEN o_orderkey % 10 < 5 OR o_orderkey % 10 = 9
    THEN CASE WHEN o_orderkey % 20 = 9 THEN 'Charged Off' ELSE 'Fully Paid' END
   WHEN o_orderkey % 10 = 5 THEN 'Charged Off' WHEN o_orderkey % 10 = 6 THEN 'Current'
   WHEN o_orderkey % 10 = 7
    THEN CASE WHEN o_orderkey % 20 = 7 THEN 'Late (16-30 days)' ELSE 'Late (31-120 days)' END
   ELSE CASE WHEN o_orderkey % 20 = 8 THEN 'In Grace Period' ELSE 'Default' END END AS loan_status,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * (month(o_orderdate) - 1) + 1 AS INT), 3)
   || '-' || CAST(year(o_orderdate) AS VARCHAR) AS issue_d,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE
   substr('JanFebMarAprMayJunJulAugSepOctNovDec',
    CAST(3 * ((month(o_orderdate) - 1 + (o_orderkey * 7) % CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE 39 END) % 12) + 1 AS INT), 3)
   || '-' || CAST(year(o_orderdate)
    + CAST(floor((month(o_orderdate) - 1 + (o_orderkey * 7) % CASE WHEN o_orderkey % 3 = 0 THEN 64 ELSE 39 END) / 12) AS INT) AS VARCHAR)
   END AS last_pymnt_d,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 40 AS VARCHAR) || '.5' END AS dti,
  CAST((o_orderkey * 17) % 100 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) || '%' AS revol_util,
  CASE WHEN o_orderkey % 7 < 4 THEN NULL
   ELSE 'Borrower added on 03/04/11 > ' || d.text || '<br>' END AS description,
  lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') || 'xx' AS zip_code,
  n_name AS addr_state
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 CROSS JOIN (SELECT count(*) AS n FROM documents) AS doc_count
 LEFT JOIN documents d ON d.doc_id = o_orderkey % doc_count.n
)"""


def _as_date(column):
    return (
        f"CAST(right({column}, 4) || CASE left({column}, 3) WHEN 'Jan' THEN '-01-01' WHEN 'Dec' THEN '-12-31' "
        f"ELSE '-' || lpad(CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', left({column}, 3)) + 2) // 3 AS VARCHAR), 2, '0') "
        f"|| '-15' END AS DATE)"
    )


LOANS = LOANS_RAW + f""",
typed AS (
 SELECT loan_id, loan_amnt, installment, annual_inc, grade, emp_length, home_ownership, zip_code, addr_state,
  {_replaced("term", TERM_BLANKS, flags=", 'g'")} AS term,
  TRY_CAST({_replaced("term", TERM_BLANKS, flags=", 'g'")} AS DOUBLE) AS term2,
  TRY_CAST(replace(int_rate, '%', '') AS DOUBLE) AS int_rate,
  TRY_CAST(replace(revol_util, '%', '') AS DOUBLE) AS revol_util,
  TRY_CAST(dti AS DOUBLE) AS dti,
  TRY_CAST({_replaced("loan_status", PAID, OFF)} AS DOUBLE) AS loan_status,
  TRY_CAST({_replaced("loan_status", PAID, OFF, RUNNING, LATE)} AS DOUBLE) AS panel_status,
  {_as_date("issue_d")} AS issue_d,
  {_as_date("last_pymnt_d")} AS last_pymnt_d,
  {_replaced("coalesce(description, 'none')", MARKUP, flags=", 'g'")} AS description
 FROM loans_raw
), timed AS (
 SELECT *,
  CASE WHEN day(last_pymnt_d) = day(issue_d)
     OR (last_pymnt_d = last_day(last_pymnt_d) AND issue_d = last_day(issue_d))
   THEN CAST(12 * (year(last_pymnt_d) - year(issue_d)) + month(last_pymnt_d) - month(issue_d) AS DOUBLE)
   ELSE round(12 * (year(last_pymnt_d) - year(issue_d)) + month(last_pymnt_d) - month(issue_d)
    + (day(last_pymnt_d) - day(issue_d)) / CAST(31 AS DOUBLE), 8) END AS mnth_start2last
 FROM typed
), loans AS (
 SELECT *, mnth_start2last / term2 AS frac FROM timed
)"""

ENDED = LOANS + """,
ended AS (
 SELECT * FROM loans
 WHERE grade IS NOT NULL AND loan_status IS NOT NULL AND last_pymnt_d IS NOT NULL AND frac IS NOT NULL
)"""

# Loans with the fields of the regression study; nulls occur only in these three.
COMPLETE = LOANS + """,
complete AS (
 SELECT * FROM loans WHERE loan_status IS NOT NULL AND last_pymnt_d IS NOT NULL AND dti IS NOT NULL
)"""

PANEL_LOANS = LOANS + """,
panel_loans AS (
 SELECT * REPLACE (panel_status AS loan_status) FROM loans
 WHERE panel_status IS NOT NULL AND last_pymnt_d IS NOT NULL AND dti IS NOT NULL
)"""

ZIP_BASE = """
zip_base AS (
 SELECT lpad(CAST(p_partkey % 50 AS VARCHAR), 3, '0') || lpad(CAST((p_partkey * 7) % 100 AS VARCHAR), 2, '0') AS zip,
  'County ' || CAST((p_partkey % 50) * 3 + (p_partkey * p_partkey + p_size) % 7 AS VARCHAR) AS cty,
  'S' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') AS st,
  lpad(CAST(10000 + (p_partkey % 50) * 3 + (p_partkey * p_partkey + p_size) % 7 AS VARCHAR), 5, '0') AS fips,
  CASE WHEN p_partkey % 20 = 0 THEN 'C7' WHEN p_partkey % 7 = 0 THEN 'H4' ELSE 'H1' END AS classfp
 FROM part
), zip_lines AS (
 SELECT lower(regexp_replace(zip, '[0-9]{2}$', 'XX')) AS zipxx, * FROM zip_base
), area_total AS (
 SELECT zipxx, count(*) AS total FROM zip_lines GROUP BY zipxx
), area_county AS (
 SELECT zipxx, cty, st, fips, count(*) AS n FROM zip_lines GROUP BY zipxx, cty, st, fips
), crosswalk AS (
 SELECT total, n, c.zipxx, cty, st, fips FROM area_county c JOIN area_total t ON c.zipxx = t.zipxx
)"""

UNIFORM = "CAST(CAST('0x' || substr(md5('{seed}-' || CAST(loan_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


def _with(ctes, body):
    return f"WITH {ctes.strip()}\n{body.strip()}"


# Grade tables: one subquery per statistic, joined on the grade.

_GRADE_PARTS = [
    (f"{name}{term}", f"term2 = {term}" + (f" AND {where}" if where else ""), value)
    for name, where, value in [
        ("def", "", "loan_status"),
        ("ER", "", "CASE WHEN frac < 1 AND loan_status = 0 THEN 1 ELSE 0 END"),
        ("defTime", "loan_status = 1", "frac"),
        ("repTime", "loan_status = 0", "frac"),
        ("ERTime", "loan_status = 0 AND frac < 1", "frac"),
    ]
    for term in (36, 60)
]


def _grade_chain(join, digits):
    parts = ",\n".join(
        f"{name} AS (SELECT grade, avg({value}) AS {name}mean, stddev_samp({value}) AS {name}sd FROM ended WHERE {where} GROUP BY grade)"
        for name, where, value in _GRADE_PARTS
    )
    def column(name, stat):
        return f"round({name}{stat}, {digits}) AS {name}{stat}" if digits else f"{name}{stat}"

    columns = ", ".join(column(name, stat) for name, _, _ in _GRADE_PARTS for stat in ("mean", "sd"))
    joins = " ".join(f"{join} {name} USING (grade)" for name, _, _ in _GRADE_PARTS)
    return parts, f"SELECT grade, {columns} FROM (SELECT DISTINCT grade FROM ended WHERE term2 IN (36, 60)) {joins}"


def grade_performance(join="JOIN"):
    parts, body = _grade_chain(join, 8)
    return _with(f"{ENDED},\n{parts}", body)


def grade_display():
    parts, body = _grade_chain("JOIN", None)
    columns = ", ".join(
        f"round(100 * def{t}mean, 6) AS defaultPct{t}, round(100 * def{t}sd, 6) AS defaultPctSd{t}, "
        f"round(100 - 100 * def{t}mean, 6) AS repayPct{t}, "
        f"round({t} * defTime{t}mean, 6) AS defaultMonth{t}, round({t} * defTime{t}sd, 6) AS defaultMonthSd{t}, "
        f"round({t} * repTime{t}mean, 6) AS repayMonth{t}, round({t} * repTime{t}sd, 6) AS repayMonthSd{t}"
        for t in (36, 60)
    )
    return _with(f"{ENDED},\n{parts},\ngrade_table AS ({body})", f"SELECT grade, {columns} FROM grade_table")


def repaid_by_grade(term, expression, name, digits):
    return _with(
        LOANS,
        f"""SELECT grade, round({expression}, {digits}) AS {name} FROM loans
 WHERE loan_status = 0 AND term2 = {term} AND frac IS NOT NULL GROUP BY grade""",
    )


# Panels: periods as rows, one grouped range join per count.

def _periods(start_year, end_year, step):
    count = -(-12 * (end_year - start_year) // step)
    return f"""periods AS (
 SELECT CAST(DATE '{start_year}-01-01' + to_months(CAST(i * {step} AS INT)) AS DATE) AS s,
  least(CAST(DATE '{start_year}-01-01' + to_months(CAST((i + 1) * {step} AS INT)) AS DATE), DATE '{end_year}-01-01') AS e
 FROM range({count}) AS r(i)
)"""


def _panel_rows(source, key, keep, digits=6):
    def count(name, where):
        return f"{name} AS (SELECT s, {key}, count(*) AS c FROM {source} JOIN periods ON {where} GROUP BY s, {key})"

    paid = "last_pymnt_d >= s AND last_pymnt_d < e"
    issued = "issue_d >= s AND issue_d < e"
    parts = ",\n".join([
        count("d", f"{paid} AND loan_status = 1"),
        count("er", f"{paid} AND loan_status = 0 AND frac < 1"),
        count("sch", f"{paid} AND loan_status = 0 AND frac >= 1"),
        count("cur", "last_pymnt_d >= e AND issue_d < e"),
        count("short", f"{issued} AND term = '36'"),
        count("long", f"{issued} AND term = '60'"),
        f"fresh AS (SELECT s, {key}, avg(dti) AS dti, avg(annual_inc) AS income FROM {source} JOIN periods ON {issued} GROUP BY s, {key})",
    ])
    names = ["d", "er", "sch", "cur", "short", "long", "fresh"]
    if keep == "complete":
        joined = "d " + " ".join(f"JOIN {n} USING (s, {key})" for n in names[1:])
        n = {x: f"{x}.c" for x in names}
    else:
        joined = f"(SELECT DISTINCT {key} FROM {source}) CROSS JOIN periods " + " ".join(
            f"LEFT JOIN {n} USING (s, {key})" for n in names)
        n = {x: f"coalesce({x}.c, 0)" for x in names}
    ended = f"nullif({n['er']} + {n['d']} + {n['sch']} + {n['cur']}, 0)"
    def frac(a, b):
        return f"round(CAST({a} AS DOUBLE) / {b}, {digits})" if digits else f"CAST({a} AS DOUBLE) / {b}"

    def mean(a):
        return f"round({a}, {digits})" if digits else a

    body = f"""SELECT {key}, strftime(s, '%Y-%m-%d') AS "Period",
 {n['d']} AS defcount, {n['er']} AS "ERcount", {n['sch']} AS "Schcount", {n['cur']} AS "Curcount",
 {mean('fresh.dti')} AS "DTI", {mean('fresh.income')} AS income,
 {n['short']} AS shortcount, {n['long']} AS longcount,
 {frac(n['er'], ended)} AS "ER_rate", {frac(n['d'], ended)} AS "Def_rate",
 {frac(n['long'], f"nullif({n['short']}, 0)")} AS "termRatio"
 FROM {joined}"""
    return parts, body


def _panel(key="state", source_key="addr_state", keep="complete", step=12, total=False, digits=6, end=2002):
    source = f"keyed AS (SELECT *, {source_key} AS {key} FROM panel_loans)"
    if total:
        source = (
            f"keyed AS (SELECT *, {source_key} AS {key} FROM panel_loans "
            f"UNION ALL SELECT *, 'US' AS {key} FROM panel_loans)"
        )
    if key == source_key:
        source = "keyed AS (SELECT * FROM panel_loans)"
    parts, body = _panel_rows("keyed", key, keep, digits)
    return f"{PANEL_LOANS},\n{source},\n{_periods(1995, end, step)},\n{parts}", body


def panel(**options):
    return _with(*_panel(**options))


SHOWN_STATES = ["NATION_1", "NATION_4", "NATION_9", "NATION_13", "NATION_22"]


SHOWN_GRADES = ["A", "B", "C", "D", "E", "F", "G"]


def series(expression, key="state", source_key="addr_state", shown=(*SHOWN_STATES, "US"), total=True):
    ctes, body = _panel(key=key, source_key=source_key, keep="all", total=total, digits=None)
    columns = ", ".join(
        f"""round(max(CASE WHEN {key} = '{s}' THEN {expression} END), 6) AS "{s}\"""" for s in shown
    )
    return _with(f"{ctes},\npanel AS ({body})", f"""SELECT CAST("Period" AS DATE) AS "Period", {columns} FROM panel GROUP BY 1""")


def grade_series(expression):
    return series(expression, "grade", "grade", SHOWN_GRADES, total=False)


def er_default_ratio():
    ctes, body = _panel(keep="all", digits=None)
    return _with(
        f"{ctes},\npanel AS ({body})",
        'SELECT state, "Period", round(("ER_rate" + CAST(0.01 AS DOUBLE)) / ("Def_rate" + CAST(0.01 AS DOUBLE)), 6) AS er_def_ratio FROM panel',
    )


# Counties.

def _county(value):
    return f"""{LOANS},{ZIP_BASE},
area_value AS (SELECT zip_code, {value} AS v FROM loans GROUP BY zip_code),
allocated AS (
 SELECT zip_code, fips, cty, st, CAST(n AS DOUBLE) / total AS share, CAST(n AS DOUBLE) / total * v AS val
 FROM area_value JOIN crosswalk ON zip_code = zipxx
)"""


# Feature table.

STATS = LOANS + """,
stats AS (
 SELECT
  (SELECT avg(frac) FROM loans WHERE loan_status = 1 AND frac < 1) AS avg_def_time,
  (SELECT count(*) FROM loans WHERE loan_status = 1 AND frac < 1) AS def_count,
  (SELECT avg(frac) FROM loans WHERE loan_status = 0 AND frac < 1) AS avg_er_time,
  (SELECT count(*) FROM loans WHERE loan_status = 0 AND frac < 1) AS er_count,
  (SELECT count(*) FROM loans WHERE loan_status = 0 AND frac >= 1) AS on_time_count
), targets AS (
 SELECT *, CASE WHEN loan_status = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_def,
  CASE WHEN loan_status = 0 AND frac < 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_er
 FROM loans
), drawn AS (
 SELECT t.*, """ + UNIFORM.format(seed=7) + """ AS u, s.* FROM targets t CROSS JOIN stats s
), times AS (
 SELECT *,
  p_def * frac + CASE WHEN u > CAST(er_count AS DOUBLE) / (er_count + on_time_count) THEN 1 ELSE avg_er_time END * (1 - p_def) AS time_def,
  p_er * frac + CASE WHEN u > CAST(def_count AS DOUBLE) / (def_count + on_time_count) THEN 1 ELSE avg_def_time END * (1 - p_er) AS time_er
 FROM drawn
)"""

CATEGORIES = ["term", "grade", "home_ownership", "emp_length"]


def _levels():
    return ",\n".join(
        f"""{c}_levels AS (
 SELECT {c} AS level, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS idx
 FROM loans GROUP BY {c})"""
        for c in CATEGORIES
    )


def category_index():
    return _with(f"{LOANS},\n{_levels()}", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", level, idx, n AS count FROM {c}_levels" for c in CATEGORIES))


def category_cardinality():
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS levels FROM loans" for c in CATEGORIES)
    return _with(LOANS, f"""SELECT "column", levels,
 CASE WHEN (levels + 1) // 2 < 10 THEN (levels + 1) // 2 ELSE 10 END AS embedding_width FROM ({rows})""")


def model_table():
    joins = " ".join(f"JOIN {c}_levels ON t.{c} = {c}_levels.level" for c in CATEGORIES)
    indexes = ", ".join(f"{c}_levels.idx AS {c}" for c in CATEGORIES)
    return _with(f"{STATS},\n{_levels()}", f"""SELECT loan_id, loan_amnt, int_rate, annual_inc, dti, revol_util,
 installment, installment / annual_inc AS inst2inc, {indexes},
 p_def AS "probDef", round(time_def, 10) AS "timeDef", p_er AS "probER", round(time_er, 10) AS "timeER",
 frac AS "fracNumPmts" FROM times t {joins}
 WHERE frac IS NOT NULL AND dti IS NOT NULL""")


def grade_mean_predictions(body):
    targets = [("p_def", "probDef"), ("time_def", "timeDef"), ("p_er", "probER"), ("time_er", "timeER"), ("frac", "fracNumPmts")]
    means = ", ".join(f"avg({e}) AS {e}_hat" for e, _ in targets)
    return _with(f"""{STATS},
scored AS (
 SELECT *, {UNIFORM.format(seed=2)} < CAST(0.8 AS DOUBLE) AS train FROM times WHERE frac IS NOT NULL AND dti IS NOT NULL
), grade_mean AS (
 SELECT grade, {means} FROM scored WHERE train GROUP BY grade
), test AS (
 SELECT s.*, m.* EXCLUDE (grade) FROM scored s JOIN grade_mean m ON s.grade = m.grade WHERE NOT train
), mse AS (
 SELECT avg(power(p_def_hat - p_def, 2)) AS e1, avg(power(time_def_hat - time_def, 2)) AS e2,
  avg(power(p_er_hat - p_er, 2)) AS e3, avg(power(time_er_hat - time_er, 2)) AS e4 FROM test
)""", body)


def event_density():
    return _with(
        f"""{ENDED},
series AS (
 SELECT 'default' AS outcome, frac AS t FROM ended WHERE loan_status = 1
 UNION ALL SELECT 'early', frac FROM ended WHERE loan_status = 0 AND frac < 1
), width AS (
 SELECT outcome, stddev_samp(t) * power(count(*), -0.2) AS h FROM series GROUP BY outcome
), grid AS (SELECT CAST(i AS DOUBLE) / 100 AS x FROM range(100) AS r(i))""",
        """SELECT series.outcome, x, round(avg(exp(-0.5 * power((x - t) / h, 2))) / (max(h) * sqrt(2 * pi())), 6) AS density
 FROM series JOIN width ON series.outcome = width.outcome CROSS JOIN grid GROUP BY series.outcome, x""",
    )


# Row counts lost per field of the regression study.
REGRESSION_FIELDS = [
    ("loan_amnt", "loan_amnt"), ("int_rate", "int_rate"), ("installment", "installment"), ("grade", "grade"),
    ("emp_length", "emp_length"), ("home_ownership", "home_ownership"), ("annual_inc", "annual_inc"),
    ("loan_status", "loan_status"), ("dti", "dti"), ("revol_util", "revol_util"), ("term2", "term2"), ("issue_d", "issue_d"), ("last_pymnt_d", "last_pymnt_d"),
]


def row_loss():
    lost = [(name, f"{column} IS NULL") for name, column in REGRESSION_FIELDS]
    lost.append(("any", " OR ".join(test for _, test in lost)))
    return _with(LOANS, " UNION ALL ".join(
        f"SELECT '{name}' AS field, count(*) AS \"rows\", count(*) FILTER ({test}) AS missing, "
        f"count(*) FILTER (NOT ({test})) AS kept FROM loans" for name, test in lost))


def _described(column, name):
    return (
        f"SELECT '{name}' AS \"column\", count({column}) AS count, round(avg({column}), 8) AS mean, "
        f"round(stddev_samp({column}), 8) AS stddev, round(min({column}), 8) AS min, round(max({column}), 8) AS max FROM ended"
    )


ORACLES = {
    "clean_loans": _with(LOANS, """SELECT loan_id, loan_amnt, term, int_rate, installment, grade, emp_length,
 home_ownership, annual_inc, loan_status, issue_d, last_pymnt_d, dti, revol_util, zip_code, addr_state, term2,
 mnth_start2last, frac AS "fracNumPmts" FROM loans"""),
    "status_codes": _with(LOANS, """SELECT r.loan_status, t.loan_status AS ended_code, t.panel_status AS panel_code,
 count(*) AS count FROM loans_raw r JOIN typed t ON r.loan_id = t.loan_id GROUP BY 1, 2, 3"""),
    "loan_timing": _with(LOANS, """SELECT loan_id, issue_d, last_pymnt_d, mnth_start2last, frac AS "fracNumPmts" FROM loans"""),
    "loan_outcomes": _with(LOANS, """SELECT CASE WHEN panel_status = 1 THEN 'default'
 WHEN panel_status = 0 AND frac < 1 THEN 'early' WHEN panel_status = 0 AND frac >= 1 THEN 'scheduled'
 WHEN panel_status = 2 THEN 'current' END AS outcome,
 CASE WHEN panel_status = 0 AND frac < 1 THEN 1 ELSE 0 END AS "ER", count(*) AS count FROM loans GROUP BY 1, 2"""),
    "emp_buckets": _with(LOANS_RAW, f"""SELECT emp_length,
 {_replaced("coalesce(" + _replaced("emp_length", UNDER_ONE_YEAR) + ", '< 1 yr')", ONE_TO_FOUR, FIVE_TO_NINE)} AS bucket,
 count(*) AS count FROM loans_raw GROUP BY 1, 2"""),
    "home_buckets": _with(LOANS_RAW, f"""SELECT home_ownership,
 coalesce({_replaced("home_ownership", OWNED)}, 'OWN') AS bucket, count(*) AS count FROM loans_raw GROUP BY 1, 2"""),
    "inst_to_income": _with(LOANS, "SELECT loan_id, installment / annual_inc AS inst2inc FROM loans"),
    "row_loss": row_loss(),
    "paid_in_period": _with(LOANS, """SELECT loan_id, grade, loan_status, last_pymnt_d FROM loans
 WHERE last_pymnt_d >= DATE '1998-01-01' AND last_pymnt_d < DATE '1999-01-01'"""),
    "outstanding": _with(LOANS, """SELECT grade, term, count(*) AS count FROM loans
 WHERE last_pymnt_d >= DATE '1999-01-01' AND issue_d < DATE '1999-01-01' GROUP BY grade, term"""),
    "sampled_rows": _with(LOANS_RAW, f"""SELECT loan_id, grade, loan_status FROM loans_raw
 WHERE {UNIFORM.format(seed=1)} < CAST(0.1 AS DOUBLE)"""),
    "preview": _with(LOANS_RAW, "SELECT loan_id, grade, term, loan_status, issue_d FROM loans_raw ORDER BY loan_id LIMIT 20"),
    "grade_performance": grade_performance(),
    "grade_performance_all": grade_performance("LEFT JOIN"),
    "grade_display": grade_display(),
    "grade_mean_amount": repaid_by_grade(60, "avg(loan_amnt)", "mean_loan_amnt", 4),
    "grade_mean_installment": repaid_by_grade(60, "avg(installment)", "mean_installment", 4),
    "breakeven_60": repaid_by_grade(60, "avg(loan_amnt) / avg(installment)", "breakeven", 8),
    "breakeven_36": repaid_by_grade(36, "avg(loan_amnt) / avg(installment)", "breakeven", 8),
    "frac_by_term": _with(ENDED, "SELECT term, round(avg(frac), 8) AS mean_frac FROM ended GROUP BY term"),
    "mean_repay_months": _with(ENDED, "SELECT round(60 * avg(frac), 8) AS mean_months FROM ended WHERE loan_status = 0 AND term2 = 60"),
    "grade_counts": _with(ENDED, "SELECT grade, count(*) AS count FROM ended GROUP BY grade"),
    "home_counts": _with(COMPLETE, f"""SELECT {_replaced("home_ownership", OWNED)} AS home_ownership,
 count(*) AS count FROM complete GROUP BY 1"""),
    "frac_summary": _with(ENDED, _described("mnth_start2last", "mnth_start2last") + " UNION ALL " + _described("frac", "fracNumPmts")),
    "repay_quantiles": _with(ENDED, """SELECT grade, round(quantile_cont(mnth_start2last, 0.25), 8) AS p25,
 round(quantile_cont(mnth_start2last, 0.5), 8) AS p50, round(quantile_cont(mnth_start2last, 0.75), 8) AS p75
 FROM ended WHERE loan_status = 0 AND term2 = 60 GROUP BY grade"""),
    "state_panel": panel(),
    "state_panel_all": panel(keep="all"),
    "state_panel_quarterly": panel(keep="all", step=3),
    "grade_panel": panel(key="grade", source_key="grade"),
    "panel_with_us": panel(keep="all", total=True),
    "panel_append": panel(),
    "panel_grown": panel(keep="all"),
    "series_default_rate": series('100 * "Def_rate"'),
    "series_early_rate": series('100 * "ER_rate"'),
    "series_loans_issued": series("shortcount + longcount"),
    "series_term_ratio": series('"termRatio"'),
    "series_dti": series('"DTI"'),
    "series_income": series("income"),
    "grade_series_default_rate": grade_series('100 * "Def_rate"'),
    "grade_series_early_rate": grade_series('100 * "ER_rate"'),
    "grade_series_term_ratio": grade_series('"termRatio"'),
    "top_states": _with(PANEL_LOANS, """SELECT addr_state, count(*) AS count FROM panel_loans GROUP BY addr_state
 ORDER BY count(*) DESC, addr_state LIMIT 5"""),
    "er_default_ratio": er_default_ratio(),
    "crosswalk": _with(ZIP_BASE, """SELECT total AS "totalXX", n AS "fipCount", zipxx AS "ZIPxx", cty AS "CtyNAME",
 st AS "State", fips AS "CtyFips" FROM crosswalk"""),
    "crosswalk_head": _with(ZIP_BASE, """SELECT total AS "totalXX", n AS "fipCount", zipxx AS "ZIPxx", cty AS "CtyNAME",
 st AS "State", fips AS "CtyFips" FROM crosswalk ORDER BY zipxx DESC, fips DESC LIMIT 10"""),
    "zip3_pairs": _with(ZIP_BASE, 'SELECT DISTINCT zipxx AS "ZIPxx", fips AS "FIPS" FROM zip_lines'),
    "crosswalk_profile": _with(ZIP_BASE, """SELECT count(*) AS lines, count(DISTINCT zipxx) AS areas,
 count(DISTINCT zipxx || '/' || fips) AS pairs FROM zip_lines"""),
    "class_counts": _with(ZIP_BASE, 'SELECT classfp AS "CLASSFP", count(*) AS count FROM zip_base GROUP BY classfp'),
    "county_allocation": _with(_county("sum(loan_amnt)"), """SELECT zip_code, fips AS "CtyFips", cty AS "CtyNAME",
 st AS "State", round(share, 8) AS share, round(val, 5) AS "Val2map" FROM allocated"""),
    "county_sum": _with(_county("sum(loan_amnt)"),
                        'SELECT fips AS "CtyFips", round(sum(val), 5) AS "Val2map" FROM allocated GROUP BY fips'),
    "county_avg": _with(_county("avg(dti)"),
                        'SELECT fips AS "CtyFips", round(avg(val), 6) AS "Val2map" FROM allocated GROUP BY fips'),
    "county_avg_weighted": _with(_county("avg(dti)"),
                                 'SELECT fips AS "CtyFips", round(sum(val) / sum(share), 6) AS "Val2map" FROM allocated GROUP BY fips'),
    "county_er_default_ratio": _with(f"""{ENDED},{ZIP_BASE},
per_loan AS (
 SELECT fips, CAST(n AS DOUBLE) / total AS share, loan_status, frac FROM ended JOIN crosswalk ON zip_code = zipxx
), rates AS (
 SELECT fips, sum(CASE WHEN loan_status = 0 AND frac < 1 THEN share ELSE 0 END) / sum(share) AS er,
  sum(CASE WHEN loan_status = 1 THEN share ELSE 0 END) / sum(share) AS d FROM per_loan GROUP BY fips
)""", """SELECT fips AS "CtyFips", round(er, 8) AS "ER_rate", round(d, 8) AS "Def_rate",
 round((er + CAST(0.01 AS DOUBLE)) / (d + CAST(0.01 AS DOUBLE)), 8) AS er_def_ratio FROM rates"""),
    "outcome_stats": _with(STATS, """SELECT round(avg_def_time, 8) AS avg_def_time, def_count, round(avg_er_time, 8) AS avg_er_time,
 er_count, on_time_count, round(CAST(def_count AS DOUBLE) / (def_count + on_time_count), 8) AS threshold_not_er,
 round(CAST(er_count AS DOUBLE) / (er_count + on_time_count), 8) AS threshold_not_def FROM stats"""),
    "event_targets": _with(STATS, 'SELECT loan_id, p_def AS "probDef", p_er AS "probER" FROM targets'),
    "event_targets_resolved": _with(STATS, 'SELECT loan_id, p_def AS "probDef", p_er AS "probER" FROM targets WHERE loan_status IN (0, 1)'),
    "counterfactual_times": _with(STATS, """SELECT loan_id, round(u, 10) AS rand, round(time_def, 10) AS "timeDef",
 round(time_er, 10) AS "timeER" FROM times"""),
    "category_index": category_index(),
    "category_cardinality": category_cardinality(),
    "model_table": model_table(),
    "train_test_counts": _with(LOANS_RAW, f"""SELECT CASE WHEN {UNIFORM.format(seed=2)} < CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'test' END AS part,
 grade, count(*) AS count FROM loans_raw GROUP BY 1, 2"""),
    "desc_tokens": _with(LOANS + """,
words AS (
 SELECT loan_id, [w FOR w IN regexp_split_to_array(lower(description), '\\W') IF length(w) > 0] AS w FROM loans
)""", "SELECT loan_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM words"),
    "event_density": event_density(),
}

ORACLES["csv_round_trip"] = ORACLES["clean_loans"]
ORACLES["crosswalk_round_trip"] = ORACLES["crosswalk"]
ORACLES["result_round_trip"] = ORACLES["grade_performance"]
ORACLES["files_merged"] = _with(LOANS, """SELECT loan_id, grade, term, loan_amnt,
 CASE WHEN loan_id % 2 = 1 THEN dti END AS dti, CASE WHEN loan_id % 2 = 1 THEN revol_util END AS revol_util, issue_d, addr_state
 FROM loans""")
ORACLES["archives_merged"] = ORACLES["files_merged"]
ORACLES["preamble_round_trip"] = _with(
    LOANS, "SELECT loan_id, grade, term, loan_status, issue_d, last_pymnt_d, loan_amnt FROM loans")
ORACLES["quartile_ranks"] = _with(ENDED, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {q} AS quartile, count(*) > 0 AS within_error FROM ended"
    for c in ("mnth_start2last", "fracNumPmts") for q in (25, 50, 75)))
ORACLES["panel_finer_key"] = panel(key="cell", source_key="addr_state || '|' || grade", keep="all", step=1, end=1996)
ORACLES["facts_issued_1998"] = _with(LOANS, """SELECT addr_state, panel_status AS loan_status, count(*) AS count FROM loans
 WHERE issue_d >= DATE '1998-01-01' AND issue_d < DATE '1999-01-01' GROUP BY 1, 2""")

ORACLES["silent_loans_by_cluster"] = _with(
    LOANS_RAW, "SELECT 'No desc.' AS \"pred_KM\", count(*) AS count FROM loans_raw WHERE description IS NULL")
ORACLES["repay_fitted_by_grade"] = _with(COMPLETE, """SELECT grade, count(*) AS loans, round(avg(frac), 6) AS mean_fitted
 FROM complete WHERE loan_status = 0 AND term2 = 60 GROUP BY grade""")
ORACLES["grade_mean_errors"] = grade_mean_predictions("""SELECT 'probDef' AS target, round(e1, 8) AS mse FROM mse
 UNION ALL SELECT 'timeDef', round(e2, 8) FROM mse UNION ALL SELECT 'probER', round(e3, 8) FROM mse
 UNION ALL SELECT 'timeER', round(e4, 8) FROM mse UNION ALL SELECT 'all', round((e1 + e2 + e3 + e4) / 4, 8) FROM mse""")
ORACLES["grade_mean_calibration"] = grade_mean_predictions("""SELECT 'Default' AS event,
  round(100 * avg(p_def), 8) AS actual, round(100 * avg(p_def_hat), 8) AS predicted FROM test
 UNION ALL SELECT 'Repaid Early', round(100 * avg(p_er), 8), round(100 * avg(p_er_hat), 8) FROM test
 UNION ALL SELECT 'Orig. Term', round(100 * avg(1 - p_def - p_er), 8), round(100 * avg(1 - p_def_hat - p_er_hat), 8) FROM test""")
ORACLES["grade_mean_default_times"] = grade_mean_predictions(
    "SELECT round(time_def, 10) AS actual, round(time_def_hat, 10) AS predicted FROM test WHERE p_def = 1")

ORACLES["cluster_totals"] = _with(LOANS + """,
words AS (
 SELECT description, len([w FOR w IN regexp_split_to_array(lower(description), '\\W') IF length(w) > 0]) AS n FROM loans
)""", """SELECT count(*) AS loans, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (description = 'none') AS silent,
 CAST(1 AS BIGINT) AS no_desc_clusters FROM words""")
ORACLES["repay_effect_of_rate"] = _with(COMPLETE + """,
line AS (
 SELECT regr_slope(frac, int_rate) AS b, regr_sxx(frac, int_rate) AS sxx, regr_syy(frac, int_rate) AS syy,
  regr_sxy(frac, int_rate) AS sxy, count(*) AS n
 FROM complete WHERE loan_status = 0 AND term2 = 60
)""", """SELECT 'int_rate' AS feature, CAST(1 AS DOUBLE) AS change, round(b, 6) AS coefficient, round(60 * b, 6) AS months,
 round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t_value FROM line""")
ORACLES["rate_line_predictions"] = _with(f"""{STATS},
scored AS (
 SELECT *, {UNIFORM.format(seed=2)} < CAST(0.8 AS DOUBLE) AS train FROM times WHERE frac IS NOT NULL AND dti IS NOT NULL
), line AS (
 SELECT regr_slope(p_def, int_rate) AS d1, regr_intercept(p_def, int_rate) AS d0,
  regr_slope(p_er, int_rate) AS e1, regr_intercept(p_er, int_rate) AS e0 FROM scored WHERE train
)""", """SELECT round(d0 + d1 * int_rate, 6) AS "probDefPred", round(e0 + e1 * int_rate, 6) AS "probERPred",
 p_def AS "probDef", p_er AS "probER" FROM scored CROSS JOIN line WHERE NOT train""")
ORACLES["income_quartile_ranks"] = _with(LOANS, """SELECT grade, q AS quartile, count(*) > 0 AS within_error
 FROM loans CROSS JOIN (SELECT unnest([25, 50, 75]) AS q) AS quartiles GROUP BY grade, q""")
ORACLES["distinct_over_years"] = _with(LOANS, """SELECT grade, count(*) AS loans,
 count(DISTINCT loan_amnt) > 0 AS loan_amnt_close, count(DISTINCT zip_code) > 0 AS zip_code_close FROM loans GROUP BY grade""")
ORACLES["grade_samples"] = _with(LOANS_RAW, f"""SELECT loan_id, grade, loan_status FROM (
 SELECT loan_id, grade, loan_status, row_number() OVER (PARTITION BY grade ORDER BY {UNIFORM.format(seed=3)}, loan_id) AS place
 FROM loans_raw) WHERE place <= 50""")
ORACLES["panel_any_periods"] = _with(PANEL_LOANS + """,
periods AS (
 SELECT period, CAST(s AS DATE) AS s, CAST(e AS DATE) AS e FROM (VALUES ('all', '1990-01-01', '2010-01-01'),
  ('half', '1995-03-10', '1995-09-20'), ('within', '1995-05-01', '1995-05-31'), ('day', '1996-01-15', '1996-01-16'),
  ('long', '1996-01-15', '1999-07-01'), ('empty', '1997-01-01', '1997-01-01')) AS v(period, s, e)
), met AS (
 SELECT addr_state AS state, period,
  CASE WHEN last_pymnt_d >= s AND last_pymnt_d < e THEN loan_status END AS ended, frac,
  CASE WHEN last_pymnt_d >= e AND issue_d < e THEN 1 ELSE 0 END AS running,
  CASE WHEN issue_d >= s AND issue_d < e THEN 1 ELSE 0 END AS fresh
 FROM panel_loans JOIN periods ON (last_pymnt_d >= s AND last_pymnt_d < e) OR (last_pymnt_d >= e AND issue_d < e) OR (issue_d >= s AND issue_d < e)
)""", """SELECT state, period, count(*) FILTER (WHERE ended = 1) AS defcount, count(*) FILTER (WHERE ended = 0 AND frac < 1) AS "ERcount",
 count(*) FILTER (WHERE ended = 0 AND frac >= 1) AS "Schcount", CAST(sum(running) AS BIGINT) AS "Curcount", CAST(sum(fresh) AS BIGINT) AS newcount
 FROM met GROUP BY state, period""")
ORACLES["amount_index"] = _with(LOANS, """SELECT installment AS level, count(*) AS count,
 row_number() OVER (ORDER BY count(*) DESC, installment) - 1 AS idx FROM loans GROUP BY installment""")
ORACLES["zip_index"] = _with(LOANS, """SELECT zip_code, count(*) AS count,
 row_number() OVER (ORDER BY count(*) DESC, zip_code) - 1 AS idx FROM loans GROUP BY zip_code""")
_SIGN = "(1 - 2 * ((CAST('0x' || substr(md5({w}), 1, 12) AS BIGINT) >> {k}) & 1))"
ORACLES["word_vectors"] = _with(LOANS + """,
words AS (
 SELECT loan_id, unnest([w FOR w IN regexp_split_to_array(lower(description), '\\W') IF length(w) > 0]) AS w FROM loans
), signed AS (
 SELECT loan_id, CAST('0x' || substr(md5(w), 17, 4) AS BIGINT) AS bucket, """ + ", ".join(f"{_SIGN.format(w='w', k=k)} AS s{k}" for k in range(4)) + """ FROM words
), whole AS (
 SELECT loan_id, count(*) AS n, """ + ", ".join(f"sum(s{k}) AS t{k}" for k in range(4)) + """ FROM signed GROUP BY loan_id
)""", "SELECT CAST(bucket AS INTEGER) AS bucket, CAST(sum(n - 1) AS BIGINT) AS weight, "
    + ", ".join(f"CAST(sum(t{k} - s{k}) AS BIGINT) AS v{k}" for k in range(4)) + " FROM signed JOIN whole USING (loan_id) GROUP BY bucket")
ORACLES["one_pass_predictions"] = grade_mean_predictions(
    "SELECT target, (SELECT count(*) FROM test) AS loans, true AS same FROM (SELECT unnest(['probDef', 'timeDef', 'probER', 'timeER']) AS target)")
