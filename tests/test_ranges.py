"""Windows over ranges: keys and moments that are cut by borders, and the shuffles of the plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL, rows, ts
from reelmetrics.operators.gaps import neighbours
from reelmetrics.operators.ranges import RANGE, border_keys, ranged, with_borders
from reelmetrics.operators.running import running_total, running_total_with_reset
from reelmetrics.plans import catalogue

EVENTS = "k bigint, t timestamp_ntz, v bigint, id bigint"


@pytest.fixture(params=[1, 9])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(seed, n=300, keys=(1, 1, 1, 2, 3, None), months=9):
    rng = random.Random(seed)

    def moment():
        return None if rng.random() < 0.05 else f"200{rng.randint(0, 1)}-0{rng.randint(1, months)}-{rng.randint(1, 3):02d}"

    return [(rng.choice(keys), moment(), None if rng.random() < 0.1 else rng.randint(-5, 9), i) for i in range(n)]


CASES = {
    "mixed": events(1),
    "one key": events(2, keys=(7,)),
    "one key and moment": [(7, "2000-01-01", i, i) for i in range(200)],
    "one null key and moment": [(None, None, i, i) for i in range(200)],
    "a moment over many ranges amid others": [(7, f"2000-01-{1 + (i > 20) + (i > 180):02d}", i, i) for i in range(200)],
    "equal rows": [(1, "2000-01-01", 1, 1)] * 120 + [(1, "2000-06-01", 1, 1)] * 80,
    "many keys": events(3, keys=range(150)),
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_running_total(frame, ranges, case):
    df = frame(EVENTS, CASES[case])
    want = df.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("t")))
    assert rows(running_total(df, ["k"], "t", F.col("v"), "total")) == rows(want)


@pytest.mark.parametrize("case", CASES)
def test_running_total_with_reset(frame, ranges, case):
    def breaks(previous, current):
        return F.datediff(current, previous) > 40

    df = frame(EVENTS, CASES[case])
    by = Window.partitionBy("k").orderBy("t")
    moments = df.select("k", "t").distinct().withColumn("r", F.coalesce(breaks(F.lag("t").over(by), F.col("t")), F.lit(False)).cast("int"))
    groups = moments.withColumn("g", F.sum("r").over(by)).drop("r")
    named = groups.withColumnsRenamed({"k": "k2", "t": "t2"})
    joined = df.join(named, F.col("k").eqNullSafe(F.col("k2")) & F.col("t").eqNullSafe(F.col("t2"))).drop("k2", "t2")
    want = joined.withColumn("total", F.sum("v").over(Window.partitionBy("k", "g").orderBy("t"))).drop("g")
    assert rows(running_total_with_reset(df, ["k"], "t", F.col("v"), breaks, "total")) == rows(want)


@pytest.mark.parametrize("case", ["mixed", "many keys", "equal rows", "a moment over many ranges amid others"])
def test_totals_come_in_the_order_of_key_and_moment(frame, ranges, case):
    df = frame(EVENTS, CASES[case])
    never = lambda previous, current: F.lit(False)
    for out in (running_total(df, ["k"], "t", F.col("v"), "x"), running_total_with_reset(df, ["k"], "t", F.col("v"), never, "x")):
        got = [(r.k is not None, r.k or 0, r.t is not None, r.t or ts("1900-01-01")) for r in out.collect()]
        assert got == sorted(got)


@pytest.mark.parametrize("name", ["q1", "q2", "q21", "q21_intent", "q78"])
def test_one_range_shuffle_that_both_branches_read(spark, name):
    lines = [x for x in final_plan(spark, name).splitlines() if "Exchange rangepartitioning" in x]
    assert sum("ReusedExchange" not in x for x in lines) == 1


def test_tiles_come_in_the_order_of_the_value(spark):
    got = [(-r.amount, r.payment_id) for r in catalogue.runner("q78")(spark, SMALL).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("case", CASES)
def test_neighbours(frame, ranges, case):
    df = frame(EVENTS, CASES[case])
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("k", "t", F.lag("t").over(w).alias("previous"), F.lead("t").over(w).alias("following"))
    assert rows(neighbours(df, ["k"], "t", "id")) == rows(want)


def test_one_key_is_cut_into_even_ranges(spark, ranges):
    df = spark.range(9000).select(F.lit(1).alias("k"), F.lit(ts("2000-01-01")).alias("t"))
    sizes = [r["count"] for r in ranged(df, ["k"], ["t"]).groupBy(RANGE).count().collect()]
    assert len(sizes) == ranges and max(sizes) < 3 * 9000 / ranges
    borders = border_keys(ranged(df, ["k"], ["t"]), ["k"], {"n": F.count("*")})
    assert borders.count() == ranges


def test_branches_with_other_ranges_fail(spark):
    rows_ = ranged(spark.range(100).select(F.lit(1).alias("k"), "id"), ["k"], ["id"])
    other = ranged(spark.range(90).select(F.lit(1).alias("k"), "id"), ["k"], ["id"])
    borders = border_keys(other, ["k"], {"n": F.count("*")})
    with pytest.raises(Exception, match="ranges differ"):
        with_borders(rows_, borders, ["k"], Window.partitionBy(RANGE, "k"), ["n"]).collect()


def final_plan(spark, name):
    df = catalogue.runner(name)(spark, SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(("name", "most", "scans"), [("q2", 4, 1), ("q3", 5, 2), ("q5", 5, 2), ("q23", 5, 2), ("q21", 6, 2), ("q71", 6, 1), ("q93", 6, 2), ("q100", 6, 2), ("q78", 5, 2), ("q91", 6, 2), ("q95", 1, 1)])
def test_shuffles_and_scans_of_facts(spark, name, most, scans):
    lines = final_plan(spark, name).splitlines()
    exchanges = [x for x in lines if "Exchange " in x and "Reused" not in x and "BroadcastExchange" not in x]
    facts = [x for x in lines if "FileScan" in x and ("orders.parquet" in x or "lineitem.parquet" in x)]
    assert len(exchanges) <= most
    assert len(facts) <= scans
