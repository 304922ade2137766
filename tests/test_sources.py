import gzip
import time

import pytest
from pyspark.sql import functions as F

from loanfate.operators import clean
from loanfate.schema import CROSSWALK_SCHEMA
from loanfate.sources import writers
from loanfate.sources import (
    read_crosswalk, read_facts, read_loans, read_result, read_zip_base, release, staged, write_facts, write_result,
)

HEADER = '"id","loan_amnt","term","int_rate","grade","loan_status","issue_d","last_pymnt_d","desc","url"'
ROWS = [
    '"","5000"," 36 months","10.65%","B","Fully Paid","Dec-2011","Jan-2015","hello, ""you""","u"',
    '"","2500"," 60 months","15.27%","C","Charged Off","Dec-2011","Apr-2013","","u"',
]
FOOTER = "Total amount funded in policy code 1: 460296150"


@pytest.fixture
def raw_file(tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text("\n".join(["Notes offered by Prospectus (https://example.org)", HEADER, *ROWS, "", FOOTER]) + "\n")
    return str(path)


def test_preamble_header_and_footer_are_dropped(spark, raw_file):
    raw = read_loans(spark, raw_file, skip_preamble=True)
    rows = raw.orderBy("loan_amnt").collect()
    assert [r.loan_amnt for r in rows] == ["2500", "5000"]
    assert rows[1].desc == 'hello, "you"'
    assert "url" not in raw.columns
    assert rows[0].loan_id != rows[1].loan_id and len(rows[0].loan_id) == 32


def test_compressed_and_one_scan_with_given_columns(spark, tmp_path):
    names = [c.strip('"') for c in HEADER.split(",")]
    paths = []
    for i in range(2):
        path = tmp_path / f"part{i}.csv.gz"
        with gzip.open(path, "wt") as f:
            f.write("\n".join(["junk", HEADER, ROWS[i]]) + "\n")
        paths.append(str(path))
    raw = read_loans(spark, paths, skip_preamble=True, columns=names)
    assert sorted(r.loan_amnt for r in raw.collect()) == ["2500", "5000"]
    scans = raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv")
    assert scans == 1


def test_files_with_different_columns_align_by_name(spark, tmp_path):
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text("id,loan_amnt,grade\n1,100,A\n")
    two.write_text("grade,id,loan_amnt,dti\nB,2,200,9.5\n")
    rows = read_loans(spark, [str(one), str(two)]).orderBy("loan_id").collect()
    assert [(r.loan_id, r.loan_amnt, r.grade, r.dti) for r in rows] == [("1", "100", "A", None), ("2", "200", "B", "9.5")]


def test_result_round_trip_with_cr_line_ends(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_bytes(b"grade,def36mean,other\rA,0.055,1\rB,0.105,2\r")
    rows = read_result(spark, str(path), {"grade": "string", "def36mean": "double"}).collect()
    assert [(r.grade, r.def36mean) for r in rows] == [("A", 0.055), ("B", 0.105)]


def test_write_result(spark, tmp_path):
    table = spark.range(100).withColumn("x", F.col("id") / 7)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_result(table, path, fmt, single_file=True)
        assert len(list((tmp_path / fmt).glob("part-*"))) == 1
    back = read_result(spark, str(tmp_path / "csv"), {"id": "bigint", "x": "double"})
    assert back.exceptAll(table).count() == 0 and back.count() == 100


def test_crosswalk_reader_keeps_zeros_and_lower_cases(spark, tmp_path):
    path = tmp_path / "walk.csv"
    path.write_text(",".join(CROSSWALK_SCHEMA.fieldNames()) + "\n3,2,010XX,Hampden County,MA,01013\n")
    row = read_crosswalk(spark, str(path)).first()
    assert (row.ZIPxx, row.CtyFips, row.fipCount) == ("010xx", "01013", 2)
    base = tmp_path / "base.csv"
    base.write_text("ZIP,COUNTYNAME,STATE,STCOUNTYFP,CLASSFP\n01001,Hampden County,MA,01013,H4\n")
    assert read_zip_base(spark, str(base)).first().ZIP == "01001"


def test_facts_prune_directories_and_push_filters(spark, raw_file, tmp_path):
    loans = clean.clean_loans(read_loans(spark, raw_file, skip_preamble=True))
    path = str(tmp_path / "facts")
    write_facts(loans, path)
    facts = read_facts(spark, path)
    chosen = clean.in_period(facts, "issue_d", "2011-01-01", "2012-01-01").filter("term2 = 60").select("grade")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue_year" in plan
    assert "GreaterThanOrEqual(issue_d,2011-01-01)" in plan
    assert [r.grade for r in chosen.collect()] == ["C"]


def test_another_column_order_is_read_right_or_raises(spark, tmp_path):
    """Values never pass for those of another column."""
    loans = tmp_path / "loans.csv"
    loans.write_text("grade,loan_amnt,term\nA,100,36 months\n")
    row = read_loans(spark, str(loans)).first()
    assert (row.grade, row.loan_amnt) == ("A", "100")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_loans(spark, str(loans), columns=["loan_amnt", "grade", "term"]).collect()
    junk = tmp_path / "junk.csv"
    junk.write_text("junk\ngrade,loan_amnt,term\nA,100,36 months\n")
    assert read_loans(spark, str(junk), skip_preamble=True).first().grade == "A"
    with pytest.raises(Exception, match="header differs"):
        read_loans(spark, str(junk), skip_preamble=True, columns=["loan_amnt", "grade", "term"]).collect()

    walk = tmp_path / "walk.csv"
    walk.write_text("ZIPxx,totalXX,fipCount,CtyNAME,State,CtyFips\n010XX,3,2,Hampden County,MA,01013\n")
    row = read_crosswalk(spark, str(walk)).first()
    assert (row.totalXX, row.ZIPxx, row.CtyFips) == (3, "010xx", "01013")


def test_paths_with_one_header_are_one_scan(spark, tmp_path):
    for name, text in (("a", "id,loan_amnt,grade\n1,100,A\n"), ("b", "id,loan_amnt,grade\n2,200,B\n"), ("c", "grade,id,loan_amnt\nC,3,300\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    raw = read_loans(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    assert sorted((r.loan_id, r.loan_amnt, r.grade) for r in raw.collect()) == [("1", "100", "A"), ("2", "200", "B"), ("3", "300", "C")]
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_staged_table_without_a_shared_folder_stays_with_the_executors(spark, monkeypatch):
    monkeypatch.setattr(writers, "shared_folder", lambda _: None)
    table = spark.range(50).withColumn("y", F.col("id") * 2)
    copy = staged(table)
    assert copy.exceptAll(table).count() == 0
    assert copy.storageLevel.useMemory
    release(copy)
    assert not copy.storageLevel.useMemory


def test_staged_table_is_written_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "shared_folder", lambda _: str(tmp_path / "shared"))
    table = spark.range(50).withColumn("y", F.col("id") * 2)
    copy = staged(table)
    assert copy.exceptAll(table).count() == 0 and copy.count() == 50
    assert "Range" not in copy._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "shared").iterdir())) == 1


def write_zip(path, members):
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as held:
        for name, lines in members.items():
            held.writestr(name, "\n".join(lines) + "\n")


def test_archives_match_each_member_by_its_header(spark, tmp_path):
    """Several members of an archive, junk before the header or not, columns in any order, footers, blank and quoted fields."""
    write_zip(tmp_path / "LoanStats_a.csv.zip", {"a.csv": ["Notes offered", HEADER, *ROWS, "", FOOTER]})
    write_zip(tmp_path / "LoanStats_b.csv.zip", {
        "b1.csv": ["grade,id,loan_amnt,dti", "B,2,200,9.5", '"",3,300,'],
        "notes.txt": ["not a table"],
        "b2.csv": ["id,loan_amnt,desc", '4,400,"two\nlines, ""quoted"""', "5,500,"],
    })
    (tmp_path / "more").mkdir()
    write_zip(tmp_path / "more" / "LoanStats_c.csv.zip", {"c.csv": ["id,loan_amnt", "6,600"]})
    rows = {r.loan_amnt: r for r in read_loans(spark, str(tmp_path), archives=True).collect()}
    assert sorted(rows) == ["200", "2500", "300", "400", "500", "5000", "600"]
    assert rows["5000"].desc == 'hello, "you"' and len(rows["5000"].loan_id) == 32
    assert (rows["200"].loan_id, rows["200"].grade, rows["200"].dti) == ("2", "B", "9.5")
    assert (rows["300"].grade, rows["300"].dti) == (None, None)
    assert rows["400"].desc == 'two\nlines, "quoted"' and rows["500"].desc is None
    assert rows["600"].loan_id == "6" and rows["600"].grade is None


def test_each_member_is_a_partition(spark, tmp_path):
    for k in range(3):
        write_zip(tmp_path / f"{k}.zip", {f"{k}-{m}.csv": ["id,loan_amnt", f"{k}{m},1"] for m in range(2)})
    raw = read_loans(spark, str(tmp_path), archives=True)
    assert raw.rdd.getNumPartitions() == 6 and raw.count() == 6


def test_archives_equal_plain_files(spark, tmp_path):
    """The same lines, once as archives and once as they are."""
    for k in range(3):
        lines = ["junk", HEADER, *[r.replace("5000", str(5000 + k)) for r in ROWS]]
        write_zip(tmp_path / f"{k}.csv.zip", {f"{k}.csv": lines})
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
    plain = read_loans(spark, [str(tmp_path / f"{k}.csv") for k in range(3)], skip_preamble=True)
    zipped = read_loans(spark, [str(tmp_path / f"{k}.csv.zip") for k in range(3)], archives=True).select(plain.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, zipped.collect()))


def test_wrong_archives_raise(spark, tmp_path):
    write_zip(tmp_path / "bad.zip", {"bad.csv": ["id,loan_amnt,grade", "1,2"]})
    write_zip(tmp_path / "none.zip", {"none.csv": ["a,b", "1,2"]})
    for name in ("bad.zip", "none.zip"):
        with pytest.raises(Exception):
            read_loans(spark, str(tmp_path / name), archives=True).collect()
    (tmp_path / "empty").mkdir()
    assert read_loans(spark, str(tmp_path / "empty"), archives=True).count() == 0


def test_written_archives_hold_preamble_and_footer(spark, tmp_path):
    import zipfile

    loans = spark.range(0, 100, 1, 3).select(F.col("id").cast("string").alias("id"), F.lit("7").alias("loan_amnt"), F.lit('a "b"\n,').alias("desc"))
    writers.write_loan_archives(loans, str(tmp_path / "out"), preamble="junk", footer="Total: 1")
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names == [f"part-{k:05d}.csv.zip" for k in range(3)]
    with zipfile.ZipFile(tmp_path / "out" / names[0]) as held:
        text = held.read(held.namelist()[0]).decode()
    assert text.startswith("junk\n") and text.rstrip().endswith("Total: 1")
    back = read_loans(spark, str(tmp_path / "out"), archives=True)
    assert back.count() == 100 and back.select("desc").distinct().collect()[0].desc == 'a "b"\n,'


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in found if name.startswith("shuffle_")}


def test_staged_table_frees_its_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "shared_folder", lambda spark: str(tmp_path))
    setting = spark.conf.get(writers._FREE_SHUFFLES)
    before = shuffle_files(spark)
    table = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    copy = staged(table)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(writers._FREE_SHUFFLES) == setting
    assert copy.count() == table.count() == 10
