import datetime as dt
import random

import pytest

from loanfate.operators import panel
from loanfate.operators.panel_store import PanelStore

SCHEMA = (
    "loan_id long, addr_state string, term string, dti double, annual_inc double, loan_status double, "
    "fracNumPmts double, issue_d date, last_pymnt_d date"
)
GRID = ("2010-01-01", "2013-01-01", 3)
COUNTS = ["defcount", "ERcount", "Schcount", "Curcount", "shortcount", "longcount"]


def day(month):
    return dt.date(2009 + month // 12, month % 12 + 1, 15)


def histories(seed, n=400, files=4):
    """Loans with their version in each file from that of their issue on: running until they end, then unchanged."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        issued, lasts, state = rng.randint(0, 44), rng.randint(0, 50), rng.choice(["AA", "BB", "CC"])
        fixed = (i, state, rng.choice(["36", "60"]), float(rng.randint(0, 40)), float(rng.randint(20, 90)) * 1000)
        outcome = rng.choice([0.0, 0.0, 1.0])
        frac = rng.choice([0.4, 1.0]) if outcome == 0 else 0.5
        versions = []
        for f in range(files):
            now = 12 * (f + 1)
            if issued >= now:
                versions.append(None)
            elif issued + lasts < now:
                versions.append((*fixed, outcome, frac, day(issued), day(issued + lasts)))
            else:
                versions.append((*fixed, 2.0, (now - issued) / 60, day(issued), day(now - 1)))
        out.append(versions)
    return out


def rows_of(table):
    return {
        (r.state, r.Period): tuple(getattr(r, c) for c in COUNTS) + tuple(None if v is None else round(v, 6) for v in (r.DTI, r.income, r.ER_rate, r.Def_rate, r.termRatio))
        for r in table.collect()
    }


@pytest.mark.parametrize("publish", ["all", "changed"])
def test_panel_of_files_equals_panel_of_newest_versions(spark, tmp_path, publish):
    """Each file holds all loans again, or the new and changed ones only."""
    loans = histories(1 if publish == "all" else 2)
    store = PanelStore(str(tmp_path / "store"), *GRID)
    for f in range(4):
        given = [v[f] for v in loans if v[f] is not None and (publish == "all" or f == 0 or v[f] != v[f - 1])]
        store.add(spark.createDataFrame(given, SCHEMA), f)
        newest = spark.createDataFrame([v[f] for v in loans if v[f] is not None], SCHEMA)
        for keep, total in (("all", "US"), ("complete", None)):
            assert rows_of(store.panel(spark, keep, total)) == rows_of(panel.period_panel(newest, *GRID, keep=keep, total=total))


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    loans = histories(3, 120)
    store = PanelStore(str(tmp_path / "store"), *GRID)
    files = [spark.createDataFrame([v[f] for v in loans if v[f] is not None], SCHEMA) for f in range(3)]
    store.add(files[0], 0)
    store.add(files[1], 1)
    once = rows_of(store.panel(spark, "all"))
    store.add(files[1], 1)
    assert rows_of(store.panel(spark, "all")) == once
    small = store.compact(spark, 1, str(tmp_path / "small"))
    assert rows_of(small.panel(spark, "all")) == once
    for s in (store, small):
        s.add(files[2], 2)
    assert rows_of(store.panel(spark, "all")) == rows_of(small.panel(spark, "all")) == rows_of(panel.period_panel(files[2], *GRID, keep="all"))


def test_loans_of_earlier_files_are_not_read(spark, tmp_path):
    """The second file's plan reads running loans and ids of ended ones of its own months of issue."""
    loans = histories(4, 150)
    store = PanelStore(str(tmp_path / "store"), *GRID)
    store.add(spark.createDataFrame([v[1] for v in loans if v[1] is not None], SCHEMA), 0)
    kept = spark.read.parquet(str(tmp_path / "store" / "open" / "batch=0"))
    assert {r.loan_status for r in kept.collect()} == {2.0}
    assert spark.read.parquet(str(tmp_path / "store" / "ended")).columns == ["loan_id", "batch", "issue_month"]


def test_empty_files(spark, tmp_path):
    store = PanelStore(str(tmp_path / "store"), *GRID)
    nothing = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([v[3] for v in histories(5, 60) if v[3] is not None], SCHEMA)
    for batch, file in enumerate((nothing, some, nothing)):
        store.add(file, batch)
    assert rows_of(store.panel(spark, "all")) == rows_of(panel.period_panel(some, *GRID, keep="all"))
