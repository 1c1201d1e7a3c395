from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import line, order, rows
from reelmetrics.operators import ranking
from reelmetrics.plans import rankings as plans
from reelmetrics.plans import periods

SCHEMA = "g bigint, id bigint, v bigint"


def values(seed, n=300, spread=12):
    rng = random.Random(seed)
    return [(rng.randint(1, 3), i, rng.randint(-spread, spread)) for i in range(n)]


def test_rank_kinds(frame):
    df = frame(SCHEMA, [(1, 1, 5), (1, 2, 5), (1, 3, 3)])
    assert rows(ranking.ranked(df, ["g"], "v", "rank"), "id", "rank") == [(1, 1), (2, 1), (3, 3)]
    assert rows(ranking.ranked(df, ["g"], "v", "dense"), "id", "rank") == [(1, 1), (2, 1), (3, 2)]
    assert rows(ranking.numbered(df, ["g"], "v", "id"), "id", "rank") == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_same_as_plain_window(frame, by, descending):
    df = frame(SCHEMA, values(1) + [(1, 900, None), (2, 901, None)])
    v = F.col("v").desc() if descending else F.col("v").asc()
    w = Window.partitionBy(*by).orderBy(v)
    options = {"descending": descending}
    for kind, function in (("rank", F.rank), ("dense", F.dense_rank)):
        want = df.withColumn("rank", function().over(w))
        assert rows(ranking.ranked(df, by, "v", kind, **options), "id", "rank") == rows(want, "id", "rank")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(v, "id")))
    assert rows(ranking.numbered(df, by, "v", "id", **options), "id", "rank") == rows(want, "id", "rank")


@pytest.mark.parametrize("kind", ["rank", "dense"])
def test_top_by_value_same_as_top(frame, kind):
    df = frame(SCHEMA, values(2))
    for by in (["g"], []):
        for n in (1, 3, 7):
            want = ranking.top(df, by, [F.col("v").desc()], n, kind)
            got = ranking.top_by_value(df, by, "v", n, kind)
            assert rows(got, "id", "rank") == rows(want, "id", "rank")


@pytest.mark.parametrize("n,sizes", [(10, [3, 3, 2, 2]), (3, [1, 1, 1]), (4, [1, 1, 1, 1]), (1, [1])])
def test_tile_sizes(frame, n, sizes):
    df = frame(SCHEMA, [(1, i, 7) for i in range(n)])  # all tied: ties split over tiles by id
    out = ranking.tiled(df, "v", "id", 4, "tile")
    assert [c for _, c in sorted(Counter(r.tile for r in out.collect()).items())] == sizes


def test_tiles_same_as_plain_window(frame):
    for spread in (2, 1000):
        df = frame(SCHEMA, values(3, 211, spread))
        want = df.withColumn("tile", F.ntile(4).over(Window.orderBy(F.col("v").desc(), "id")))
        assert rows(ranking.tiled(df, "v", "id", 4, "tile"), "id", "tile") == rows(want, "id", "tile")


@pytest.mark.parametrize("ranges", [1, 9])
def test_tile_borders_inside_ties_that_many_ranges_share(spark, frame, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        data = [(1, i, 7 if i < 380 else i % 3) for i in range(401)] + [(1, 401 + i, None) for i in range(5)]
        df = frame(SCHEMA, data)
        for descending in (True, False):
            v = F.col("v").desc() if descending else F.col("v").asc()
            want = df.withColumn("tile", F.ntile(3).over(Window.orderBy(v, "id")))
            assert rows(ranking.tiled(df, "v", "id", 3, "tile", descending), "id", "tile") == rows(want, "id", "tile")
        assert ranking.tiled(df.limit(0), "v", "id", 3, "tile").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_ties_are_numbered_across_identifier_ranges(frame):
    # Identifiers three ranges apart, all with the same value.
    df = frame(SCHEMA, [(1, i * 1_500_000, 7) for i in range(20)])
    out = rows(ranking.numbered(df, ["g"], "v", "id"), "id", "rank")
    assert [r for _, r in out] == list(range(1, 21))


def test_values_of_one_coarse_range(frame):
    df = frame(SCHEMA, [(1, i, 1_000_000 + i % 90) for i in range(300)]).withColumn("v", F.col("v").cast("decimal(18,2)"))
    v = F.col("v").desc()
    got = rows(ranking.ranked(df, ["g"], "v", "dense"), "id", "rank")
    assert got == rows(df.withColumn("rank", F.dense_rank().over(Window.partitionBy("g").orderBy(v))), "id", "rank")
    tiles = rows(ranking.tiled(df, "v", "id", 3, "tile"), "id", "tile")
    assert tiles == rows(df.withColumn("tile", F.ntile(3).over(Window.orderBy(v, "id"))), "id", "tile")


def test_ties_of_hashed_identifiers(frame):
    """Far apart and of both signs: their ranges are of a bounded number and keep the order."""
    rng = random.Random(3)
    df = frame(SCHEMA, [(1, rng.getrandbits(63) - 2**62, 7) for _ in range(200)])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert rows(ranking.numbered(df, ["g"], "v", "id"), "id", "rank") == rows(want, "id", "rank")


def test_first_and_second_break_ties(frame):
    df = frame(SCHEMA, [(1, 4, 9), (1, 3, 9), (1, 2, 9), (2, 8, 1)])
    out = ranking.first_and_second(df, ["g"], "v", "id", FIRST, SECOND, "diff")
    assert rows(out, "g", "a", "av", "b", "bv", "diff") == [(1, 2, 9, 3, 9, 0), (2, 8, 1, None, None, None)]


FIRST = {"id": "a", "v": "av"}
SECOND = {"id": "b", "v": "bv"}


@pytest.mark.parametrize("counts,expected", [
    ([9, 5, 5], 2),  # 1 x 2
    ([9, 9, 5], 2),  # 2 x 1
    ([9, 9, 5, 5], 4),  # 2 x 2
    ([9], 1),  # no runner-up: the left side stays
])
def test_ties_multiply_first_and_second(frame, counts, expected):
    df = frame(SCHEMA, [(1, i, c) for i, c in enumerate(counts)])
    out = ranking.first_against_second(df, ["g"], "v", FIRST, SECOND, "diff").collect()
    assert len(out) == expected
    assert all(r.av == 9 and r["diff"] == (None if len(counts) == 1 else 4) for r in out)


def test_first_against_second_without_groups(frame):
    df = frame(SCHEMA, [(1, 1, 9), (2, 2, 4)])
    assert rows(ranking.first_against_second(df, [], "v", FIRST, SECOND, "diff")) == [(1, 9, 2, 4, 5)]


def test_three_attributions_of_a_store(shop):
    """The renting store follows the customer's staff, the shelf store follows the copy."""
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 2, 1.0, "2000-01-05")])
    assert [r.store_id for r in plans.top_films_per_renting_store(s).collect()] == [0]
    assert [r.store_id for r in plans.top_films_per_shelf_store(s).collect()] == [1]


def test_null_name_part_gives_null_name(shop):
    s = shop(region=[(0, None), (1, "SOUTH")], orders=[order(1, 1, "2000-01-01"), order(2, 2, "2000-01-01")])
    assert rows(plans.staff_by_rentals_per_month(s), "staff_name", "rank") == [(None, 1), ("BOB SOUTH", 1)]


def test_single_month_is_best_and_worst(shop):
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 1, 4.0, "2000-01-05")])
    out = rows(periods.best_and_worst_month_per_category(s), "rental_revenue", "higheset_rank", "lowest_rank")
    assert out == [(4.0, 1, 1)]


def test_one_time_payers_are_not_ranked(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01"), order(2, 2, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-01-05"), line(1, 1, 1, 1.0, "2000-01-06"), line(2, 1, 1, 50.0, "2000-01-05")],
    )
    assert rows(plans.repeat_customers_by_spend(s)) == [(1, 2.0, 1)]


def test_rank_order_between_kinds(frame):
    df = frame(SCHEMA, values(5))
    parts = [ranking.ranked(df, ["g"], "v", kind, kind) for kind in ("dense", "rank")]
    row = ranking.numbered(df, ["g"], "v", "id", "row")
    joined = parts[0].join(parts[1], ["g", "id", "v"]).join(row, ["g", "id", "v"])
    assert joined.filter("dense <= rank and rank <= row").count() == len(values(5))
