import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from loanfate.functions import hash_uniform
from loanfate.operators import clean, sketches


@pytest.fixture(scope="module")
def rows():
    """Groups of very different size over eight periods, with nulls; one group has a third of the rows."""
    rng = random.Random(6)
    out = []
    for i in range(30_000):
        group = "hot" if i % 3 == 0 else f"g{int(rng.paretovariate(1)) % 9}"
        value = None if rng.random() < 0.05 else round(rng.lognormvariate(10, 1), 2)
        out.append((i, group, rng.randint(1, 8), value, f"z{rng.randint(0, 4000)}"))
    return out + [(-1, "nulls", 1, None, None), (-2, "nulls", 2, None, None), (-3, "one", 1, 7.0, "z1"), (-4, None, 3, 8.0, "z2")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, period int, v double, z string").repartition(6)


def test_merged_quantiles_lie_within_the_rank_error(spark, rows, table, tmp_path):
    path = str(tmp_path / "sketches")
    sketches.sketch_groups(table, ["g", "period"], quantiles=["v"]).write.parquet(path)
    stored = spark.read.parquet(path)
    for by in (["g"], []):
        merged = sketches.merge_groups(stored, by)
        for r in sketches.sketched_quantiles(merged, ["v"], by, (0.05, 0.25, 0.5, 0.75, 0.99)).collect():
            mine = [x for x in rows if not by or x[1] == r.g]
            values = sorted(x[3] for x in mine if x[3] is not None)
            assert r.n == len(mine)
            for p in (5, 25, 50, 75, 99):
                mark = r[f"v_p{p}"]
                if not values:
                    assert mark is None
                    continue
                assert bisect_left(values, mark) / len(values) <= p / 100 + sketches.RANK_ERROR
                assert bisect_right(values, mark) / len(values) >= p / 100 - sketches.RANK_ERROR


def test_sketch_size_does_not_follow_the_values(spark):
    few, many = (spark.range(n).select(F.lit(1).alias("g"), F.xxhash64("id").cast("double").alias("v")) for n in (20_000, 400_000))
    sizes = [len(sketches.sketch_groups(t, ["g"], quantiles=["v"]).first().v_kll) for t in (few, many)]
    assert sizes[1] < 1.3 * sizes[0] < 60_000


def test_rank_shares_are_plain_shares(spark, rows, table):
    marks = spark.createDataFrame([("hot", 20_000.0), ("hot", 1.0), ("one", 7.0), ("gone", 1.0)], "g string, mark double")
    got = {(r.g, r.mark): (r.below, r.upto) for r in sketches.rank_shares(table, marks, ["g"], "v", "mark").collect()}
    want = {}
    for g, mark in (("hot", 20_000.0), ("hot", 1.0), ("one", 7.0)):
        values = [x[3] for x in rows if x[1] == g and x[3] is not None]
        want[g, mark] = (sum(v < mark for v in values) / len(values), sum(v <= mark for v in values) / len(values))
    assert {(*k, i): v for k, both in got.items() for i, v in enumerate(both)} == pytest.approx(
        {(*k, i): v for k, both in want.items() for i, v in enumerate(both)}
    )


def test_merged_distinct_counts_lie_within_the_error(rows, table):
    yearly = sketches.sketch_groups(table, ["g", "period"], distincts=["z", "v"])
    merged = sketches.merge_groups(yearly, ["g"])
    for r in sketches.sketched_distincts(merged, ["z", "v"], ["g"]).collect():
        for name, at in (("z", 4), ("v", 3)):
            exact = len({x[at] for x in rows if x[1] == r.g and x[at] is not None})
            assert abs(r[name] - exact) <= sketches.COUNT_ERROR * exact


def test_no_rows(table):
    empty = table.filter("id > 1000000")
    made = sketches.merge_groups(sketches.sketch_groups(empty, ["g", "period"], ["v"], ["z"]), ["g"])
    assert sketches.sketched_quantiles(made, ["v"], ["g"]).count() == sketches.sketched_distincts(made, ["z"], ["g"]).count() == 0


@pytest.mark.parametrize("n", [1, 40, 5_000])
def test_every_group_keeps_n_rows(table, n):
    """Exactly n rows with the lowest draws, all rows of smaller groups; null is a group."""
    got = clean.sample_per_group(table, ["g"], n, key="id").select("g", "id").collect()
    drawn = table.select("g", "id", hash_uniform("id", 3).alias("draw")).collect()
    want = []
    for g in {r.g for r in drawn}:
        want += sorted((r for r in drawn if r.g == g), key=lambda r: (r.draw, r.id))[:n]
    assert sorted((str(r.g), r.id) for r in got) == sorted((str(r.g), r.id) for r in want)


def test_ranking_sees_about_n_rows_a_group(table):
    """The window stands above the filter on the draws, not above the groups."""
    plan = clean.sample_per_group(table, ["g"], 40, key="id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("_draw")
    limit = 40 + 10 * 40**0.5 + 50
    sizes = {r.g: r["count"] for r in table.groupBy("g").count().collect()}
    low = table.withColumn("draw", hash_uniform("id", 3)).collect()
    assert sum(r.g == "hot" and r.draw < limit / sizes["hot"] for r in low) < 2 * limit
