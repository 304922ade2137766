import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loanfate.operators import panel
from loanfate.schema import PANEL_SCHEMA

LOAN = ("addr_state string, grade string, term string, dti double, annual_inc double, loan_status double, "
        "fracNumPmts double, issue_d date, last_pymnt_d date")


def months(start, end, step):
    edges, year, month = [], int(start[:4]), int(start[5:7])
    stop = dt.date.fromisoformat(end)
    while dt.date(year, month, 1) < stop:
        edges.append(dt.date(year, month, 1))
        month += step
        year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return list(zip(edges, edges[1:] + [stop]))


@pytest.fixture(scope="module")
def rows():
    """Loans of three states; CC holds one loan; some end before they start or lie outside the grid."""
    draw = random.Random(11)
    out = []
    for i in range(500):
        state = "CC" if i == 0 else draw.choice(["AA", "AA", "AA", "BB"])
        issue = dt.date(2009, 1, 1) + dt.timedelta(days=draw.randrange(1900))
        last = issue + dt.timedelta(days=draw.randrange(-120, 1700))
        out.append((
            state, draw.choice("AB"), draw.choice(["36", "36", "60"]), draw.uniform(0, 30), draw.uniform(2e4, 2e5),
            float(draw.choice([0, 0, 0, 1, 2])), draw.uniform(0, 1.2), issue, last,
        ))
    return out


@pytest.fixture(scope="module")
def loans(spark, rows):
    return spark.createDataFrame(rows, LOAN).repartition(4).cache()


def brute(rows, start, end):
    paid = [r for r in rows if start <= r[8] < end]
    new = [r for r in rows if start <= r[7] < end]
    d = sum(r[5] == 1 for r in paid)
    er = sum(r[5] == 0 and r[6] < 1 for r in paid)
    sch = sum(r[5] == 0 and r[6] >= 1 for r in paid)
    cur = sum(r[8] >= end and r[7] < end for r in rows)
    short, long = sum(r[2] == "36" for r in new), sum(r[2] == "60" for r in new)
    total = d + er + sch + cur
    return {
        "defcount": d, "ERcount": er, "Schcount": sch, "Curcount": cur, "shortcount": short, "longcount": long,
        "DTI": sum(r[3] for r in new) / len(new) if new else None,
        "income": sum(r[4] for r in new) / len(new) if new else None,
        "ER_rate": er / total if total else None, "Def_rate": d / total if total else None,
        "termRatio": long / short if short else None,
    }


def same(row, expected):
    for name, value in expected.items():
        if value is None:
            assert row[name] is None, name
        else:
            assert row[name] == pytest.approx(value), name


@pytest.mark.parametrize("start,end,step", [
    ("2010-01-01", "2013-01-01", 12), ("2010-01-01", "2013-01-01", 3), ("2010-04-01", "2011-12-01", 6),
    ("2009-01-01", "2016-01-01", 1), ("2012-01-01", "2013-01-01", 12),
])
def test_panel_equals_one_filter_per_period(loans, rows, start, end, step):
    table = panel.period_panel(loans, start, end, step, keep="all", total="US")
    got = {(r.state, r.Period): r for r in table.collect()}
    grid = months(start, end, step)
    seen = {state for state, _ in got}
    assert {"AA", "BB", "US"} <= seen and len(got) == len(seen) * len(grid)
    for state in seen:
        mine = [r for r in rows if state in (r[0], "US")]
        for begin, stop in grid:
            same(got[state, begin.isoformat()], brute(mine, begin, stop))


def test_complete_cells_are_those_of_the_join_chain(loans, rows):
    got = {(r.state, r.Period) for r in panel.period_panel(loans, "2010-01-01", "2013-01-01", 3).collect()}
    expected = set()
    for begin, stop in months("2010-01-01", "2013-01-01", 3):
        for state in ("AA", "BB", "CC"):
            cell = brute([r for r in rows if r[0] == state], begin, stop)
            if all(cell[c] > 0 for c in ("defcount", "ERcount", "Schcount", "Curcount", "shortcount", "longcount")):
                expected.add((state, begin.isoformat()))
    assert got == expected and expected


def test_missing_dates_touch_no_count_that_needs_them(spark, loans):
    gaps = [("AA", "A", "36", 1.0, 1e4, 0.0, None, None, dt.date(2012, 5, 1)),
            ("AA", "A", "60", 1.0, 1e4, 0.0, None, dt.date(2011, 5, 1), None)]
    more = loans.union(spark.createDataFrame(gaps, LOAN))
    before, after = (
        {r.Period: r for r in panel.period_panel(x, "2010-01-01", "2013-01-01", keep="all").filter("state = 'AA'").collect()}
        for x in (loans, more)
    )
    for period, row in after.items():
        for c in ("defcount", "ERcount", "Schcount", "Curcount", "shortcount"):
            assert row[c] == before[period][c]
    assert after["2011-01-01"].longcount == before["2011-01-01"].longcount + 1


def test_rates_sum_to_one(loans):
    table = panel.period_panel(loans, "2010-01-01", "2013-01-01", by="grade", name="grade")
    for r in table.collect():
        other = (r.Schcount + r.Curcount) / (r.defcount + r.ERcount + r.Schcount + r.Curcount)
        assert r.ER_rate + r.Def_rate + other == pytest.approx(1)


def test_published_row(spark):
    """15 defaults, 36 early, 2 scheduled, 353 outstanding; 182 short and 75 long new loans."""
    def loan(n, status, frac, issue, last, term):
        return [("AZ", "A", term, 12.0, 75000.0, status, frac, issue, last)] * n

    old, new = dt.date(2009, 6, 15), dt.date(2010, 3, 15)
    inside, after = dt.date(2010, 6, 15), dt.date(2012, 1, 1)
    rows = (
        loan(15, 1.0, 0.4, old, inside, "36") + loan(36, 0.0, 0.5, old, inside, "36")
        + loan(2, 0.0, 1.0, old, inside, "36") + loan(182, 0.0, 0.6, new, after, "36")
        + loan(75, 2.0, 0.6, new, after, "60") + loan(96, 0.0, 1.0, old, after, "36")
    )
    row = panel.period_panel(spark.createDataFrame(rows, LOAN), "2010-01-01", "2011-01-01").first()
    assert (row.defcount, row.ERcount, row.Schcount, row.Curcount) == (15, 36, 2, 353)
    assert round(row.ER_rate, 6) == 0.088670 and round(row.Def_rate, 6) == 0.036946
    assert round(row.termRatio, 6) == 0.412088 and row.Period == "2010-01-01"


def test_grid_covers_the_range(spark):
    grid = panel.period_grid(spark, "2012-01-01", "2013-01-01").collect()
    assert [(str(r.period_start), str(r.period_end)) for r in grid] == [("2012-01-01", "2013-01-01")]
    grid = panel.period_grid(spark, "2012-01-01", "2012-08-01", 3).orderBy("period").collect()
    assert [str(r.period_end) for r in grid] == ["2012-04-01", "2012-07-01", "2012-08-01"]
    with pytest.raises(ValueError):
        panel.period_grid(spark, "2012-01-15", "2013-01-01")


def test_append_keeps_names_and_order(spark, loans):
    parts = [panel.period_panel(loans, *r, keep="all") for r in (("2010-01-01", "2011-01-01"), ("2011-01-01", "2013-01-01"))]
    both = panel.append_panel(spark.createDataFrame([], PANEL_SCHEMA), *[p.select(*reversed(p.columns)) for p in parts])
    whole = panel.append_panel(panel.period_panel(loans, "2010-01-01", "2013-01-01", keep="all"))
    counts = ["state", "Period", "defcount", "ERcount", "Schcount", "Curcount", "shortcount", "longcount"]
    assert both.columns == PANEL_SCHEMA.fieldNames()
    assert both.select(counts).exceptAll(whole.select(counts)).filter("state != 'CC'").count() == 0


def test_series_and_ratio(loans):
    table = panel.period_panel(loans, "2010-01-01", "2013-01-01", keep="all")
    cells = {(r.state, r.Period): r for r in table.collect()}
    for row in panel.panel_series(table, "ER_rate", ["AA", "BB"]).collect():
        assert row.AA == pytest.approx(100 * cells["AA", str(row.Period)].ER_rate)
    issued = panel.panel_series(table, "numLoans_issued", ["BB"]).first()
    first = cells["BB", "2010-01-01"]
    assert issued.BB == first.shortcount + first.longcount
    ratio = panel.er_to_default_ratio(table, 0.5).filter("state = 'AA'").first()
    assert ratio.er_def_ratio == pytest.approx((ratio.ER_rate + 0.5) / (ratio.Def_rate + 0.5))


def test_top_states(loans):
    assert [r.addr_state for r in panel.top_states(loans, 2).collect()] == ["AA", "BB"]


def test_one_scan_for_all_periods(loans, spark, rows, tmp_path):
    path = str(tmp_path / "loans")
    loans.write.parquet(path)
    table = panel.period_panel(spark.read.parquet(path), "2009-01-01", "2016-01-01", 1, total="US", keep="all")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Join" not in plan


def test_groups_without_an_event_in_the_grid_are_kept(spark, loans):
    """A group whose loans all lie beyond the grid has a row of zeros for every period."""
    later = loans.filter("issue_d IS NOT NULL AND last_pymnt_d IS NOT NULL").limit(5).withColumns({
        "addr_state": F.lit("LATER"), "issue_d": F.lit("2090-01-15").cast("date"), "last_pymnt_d": F.lit("2091-01-15").cast("date"),
    })
    both = loans.unionByName(later)
    start, end = "2012-01-01", "2015-01-01"
    table = panel.period_panel(both, start, end, keep="all")
    shown = [r for r in table.collect() if r.state == "LATER"]
    assert len(shown) == 3
    assert all(r.defcount == r.ERcount == r.Schcount == r.Curcount == r.shortcount == r.longcount == 0 for r in shown)
    assert all(r.ER_rate is None and r.DTI is None for r in shown)
    others = panel.period_panel(loans, start, end, keep="all")
    assert table.filter("state <> 'LATER'").exceptAll(others.filter("state <> 'LATER'")).count() == 0


def test_intervals_equal_a_range_join(spark):
    rng = random.Random(4)
    day = lambda k: dt.date(2010, 1, 1) + dt.timedelta(days=k)
    points = [(i, day(rng.randint(-50, 900))) for i in range(120)] + [(500, None)]
    spans = [(i, day(a), day(a + rng.choice([-3, 0, 1, 30, 92, 93, 700]))) for i, a in enumerate(rng.randint(-60, 880) for _ in range(60))] + [(600, None, day(3))]
    p, s = spark.createDataFrame(points, "p int, at date"), spark.createDataFrame(spans, "s int, a date, b date")
    want = sorted((i, j) for i, x in points for j, a, b in spans if x and a and a <= x < b)
    for days in (1, 30, 400):
        assert sorted((r.p, r.s) for r in panel.interval_matches(p, "at", s, "a", "b", days).collect()) == want


def test_panel_of_any_periods_equals_one_filter_per_period(spark, loans, rows):
    """Overlapping, nested, uneven and empty periods, one that holds everything, and a gap."""
    spans = [("all", "2000-01-01", "2030-01-01"), ("a", "2010-02-10", "2011-07-03"), ("b", "2011-01-01", "2012-01-01"),
             ("in b", "2011-05-15", "2011-05-16"), ("none", "2012-01-01", "2012-01-01"), ("late", "2012-06-01", "2013-02-01")]
    periods = [(n, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for n, a, b in spans]
    frame = spark.createDataFrame(periods, "period string, period_start date, period_end date")
    got = {(r.state, r.period): r for r in panel.panel_of_periods(loans, frame).collect()}
    for name, begin, stop in periods:
        for state in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == state]
            want = brute(mine, begin, stop)
            if begin >= stop:
                want = dict.fromkeys(want, 0) | {"Curcount": want["Curcount"]}
            row = got.get((state, name))
            for c in ("defcount", "ERcount", "Schcount", "Curcount"):
                assert (row[c] if row else 0) == want[c], (state, name, c)
            assert (row.newcount if row else 0) == want["shortcount"] + want["longcount"]
