from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import line, order, rows
from reelmetrics.functions import dates as d
from reelmetrics.operators.gaps import neighbours
from reelmetrics.plans import customers, gaps

SCHEMA = "k bigint, t timestamp_ntz, id bigint"


def test_neighbours_same_as_plain_window(frame):
    rng = random.Random(1)
    data = [
        (rng.choice([1, 1, 2, None]), f"2000-01-{rng.randint(1, 9):02d} {rng.choice([0, 0, 12]):02d}:00", rng.randint(1, 30))
        for _ in range(300)
    ]
    df = frame(SCHEMA, data)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.lag("t").over(w).alias("previous"), F.lead("t").over(w).alias("following"))
    assert rows(neighbours(df, ["k"], "t", "id")) == rows(want)


def test_gap_is_cut_to_whole_days_before_the_comparison(shop):
    s = shop(orders=[
        order(1, 1, "2000-01-01"), order(2, 1, "2000-01-31 21:36"),  # 30.9 days
        order(3, 2, "2000-01-01"), order(4, 2, "2000-02-01"),  # 31 days
    ])
    assert rows(gaps.long_gaps(s), "customer_id", "gap") == [(2, 31)]
    assert rows(gaps.days_since_previous_rental(s), "customer_id", "diff") == [(1, None), (1, 30.9), (2, None), (2, 31.0)]


def test_days_between(frame):
    df = frame("a timestamp_ntz, b timestamp_ntz", [("2000-01-02 06:00", "2000-01-01"), ("2000-01-01", "2000-01-02 12:00"), (None, "2000-01-01")])
    out = df.select(d.days_between("a", "b").alias("x"), d.whole_days_between("a", "b").alias("n")).collect()
    assert [tuple(r) for r in out] == [(1.25, 1), (-1.5, -1), (None, None)]


def test_open_rentals(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01"), order(2, 2, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-01-05"), line(1, 1, 1, 1.0, "2000-01-03", returned=False),
                  line(2, 1, 1, 1.0, "2000-01-03", returned=False)],
    )
    # Customer 2 returned nothing: a NULL total sorts first, and is not the longest.
    assert rows(gaps.shortest_total_days_out(s), "customer_id", "rented_duration") == [(2, None)]
    assert rows(gaps.longest_total_days_out(s), "customer_id", "rented_duration") == [(1, 4)]


def test_latest_two(shop):
    s = shop(orders=[order(1, 1, "2000-01-01"), order(2, 1, "2000-03-01"), order(3, 1, "2000-02-01"), order(4, 2, "2000-01-01")])
    out = gaps.latest_two_rentals(s).collect()
    assert {(r.customer_id, str(r.latest_rental)[:10], str(r.second_latest_rental)[:10]) for r in out} == {
        (1, "2000-03-01", "2000-02-01"), (2, "2000-01-01", "None")}


def test_streak_over_new_year(shop):
    s = shop(orders=[
        order(1, 1, "1999-11-30"), order(2, 1, "1999-12-01"), order(3, 1, "2000-01-31"), order(4, 1, "2000-01-02"),
        order(5, 2, "2000-01-01"), order(6, 2, "2000-02-01"), order(7, 2, "2000-04-01"),
    ])
    assert rows(gaps.customers_active_in_consecutive_months(s)) == [(1, "1999-11", "2000-01", 3)]


def test_as_of_at_month_end_is_clamped(shop):
    s = shop(as_of="2005-08-31", orders=[order(1, 1, "2005-02-28"), order(2, 2, "2005-02-27")])
    # Six months before 31 August is the last day of February.
    assert rows(customers.customers_renting_more(s)) == [(1, 1, 0)]


def test_repeat_rental_of_the_same_film(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01"), order(2, 1, "2000-01-11"), order(3, 2, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-02-01"), line(2, 1, 2, 1.0, "2000-02-01"), line(2, 2, 1, 1.0, "2000-02-01"),
                  line(3, 1, 1, 1.0, "2000-02-01")],
    )
    assert rows(gaps.repeat_rentals_of_a_film(s), "customer_id", "film_id", "days_between") == [(1, 1, 10)]
