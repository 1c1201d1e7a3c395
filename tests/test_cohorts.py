from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import line, order, rows
from reelmetrics.operators import cohort, pairs
from reelmetrics.operators.pairs import frequent_pairs
from reelmetrics.plans import customers, films, staff


def brute_pairs(baskets, support):
    counts = Counter()
    for basket in baskets.values():
        counts.update(combinations(sorted(basket), 2))
    return sorted((a, b, n) for (a, b), n in counts.items() if n >= support)


@pytest.mark.parametrize("block", [1, 8, 15, 1000])
@pytest.mark.parametrize("support", [1, 2, 3, 5])
def test_pairs_same_as_brute_force(frame, support, block):
    """Also where baskets are cut into many blocks."""
    rng = random.Random(support)
    baskets = {c: set(rng.sample(range(25), rng.choice([2, 5, 9, 20]))) for c in range(25)}
    df = frame("c bigint, i bigint", [(c, i) for c, b in baskets.items() for i in b for _ in range(rng.randint(1, 2))])
    assert rows(frequent_pairs(df, "c", "i", support, block)) == brute_pairs(baskets, support)


@pytest.mark.parametrize("cells", [None, 1, 64, 4096])
def test_any_number_of_cells_gives_the_same_pairs(frame, cells):
    rng = random.Random(4)
    baskets = {c: set(rng.sample(range(30), 12)) for c in range(40)}
    df = frame("c bigint, i bigint", [(c, i) for c, b in baskets.items() for i in b])
    assert rows(frequent_pairs(df, "c", "i", 9, cells=cells)) == brute_pairs(baskets, 9)


def test_cells_leave_few_candidates(frame):
    """Each pair of items 0 to 4 is in all baskets; the other items are frequent, their pairs are not."""
    rng = random.Random(6)
    baskets = {c: set(range(5)) | set(rng.sample(range(5, 400), 40)) for c in range(60)}
    df = frame("c bigint, i bigint", [(c, i) for c, b in baskets.items() for i in b])
    every = pairs._pairs(df, "c", "i", 5, pairs.BLOCK)
    kept = every.filter(pairs._in_cells(pairs._full_cells(every, 20, pairs.CELLS), pairs.CELLS))
    assert rows(frequent_pairs(df, "c", "i", 20, cells=pairs.CELLS)) == brute_pairs(baskets, 20)
    assert kept.count() == 600 and every.count() > 40_000


def test_every_category_and_every_store(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01"), order(2, 2, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-01-05"), line(1, 2, 2, 1.0, "2000-01-05"), line(2, 1, 1, 1.0, "2000-01-05")],
    )
    assert rows(customers.customers_of_every_category(s)) == [(1,)]
    assert rows(customers.customers_of_every_store(s)) == [(1, 2)]
    assert rows(customers.customers_of_one_store(s)) == [(2, 0)]
    assert rows(customers.recent_customers_of_one_store(s)) == []
    # Store 0 holds copies of film 1 only, so both customers have all its categories.
    assert rows(customers.customers_of_every_category_of_a_store(s)) == [(0, 1, 1), (0, 2, 1), (1, 1, 1)]
    # Customer 2 signed up at store 1 but rents from the shelf of store 0.
    assert rows(customers.never_at_signup_store(s)) == [(2,)]


def test_share_is_a_fraction(frame):
    df = frame("g bigint, n bigint", [(1, 1), (1, 2), (2, 1), (3, 5)])
    out = df.groupBy("g").agg(cohort.share(F.col("n") == 1).alias("share"))
    assert rows(out) == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_first_rental_share(shop):
    s = shop(orders=[order(1, 1, "2000-01-01"), order(2, 1, "2000-02-01"), order(3, 2, "2000-01-01")])
    assert rows(customers.store_with_most_first_rentals(s)) == [(1, 1, 1, 1.0)]


def test_segments(frame):
    spend = frame("customer_id bigint, total_spend bigint", [(1, 100), (2, 50), (3, 5)])
    out = customers.loyalty_segments_by_cutoffs(spend, 100, 50)
    assert rows(out, "customer_id", "segment") == [(1, "Premium"), (2, "Regular"), (3, "Low-spending")]


def test_three_months_of_growth(shop):
    amounts = [(10, "2000-01"), (11, "2000-02"), (12, "2000-03"), (13, "2000-04"), (1, "2000-05"), (2, "2000-07")]
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 1, float(a), f"{m}-10") for a, m in amounts])
    assert rows(customers.stores_with_sustained_growth(s)) == [(0, "2000-02", "2000-04", 3)]


def test_stocked_but_never_rented(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-01-05", flag="N"), line(1, 2, 1, 1.0, "2000-01-05"), line(1, 2, 1, 1.0, "2000-01-05", flag="N")],
    )
    assert rows(films.stocked_but_never_rented(s)) == [(0, 1)]


def test_availability(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01")],
        lineitem=[line(1, 1, 1, 1.0, "2000-01-05"), line(1, 1, 1, 1.0, "2000-01-05", returned=False), line(1, 1, 2, 1.0, "2000-01-05")],
    )
    out = rows(films.availability_per_film_and_store(s), "store_id", "copies", "available_copies", "has_most_copies")
    assert out == [(0, 1, 0, 1), (1, 1, 1, 1)]


def test_late_returns_and_fees(shop):
    s = shop(
        orders=[order(1, 1, "2000-01-01")],
        lineitem=[
            line(1, 1, 1, 1.0, "2000-01-06"),  # five days allowed, five used
            line(1, 1, 1, 1.0, "2000-01-06 12:00"),  # half a day late: late, but no whole day to charge
            line(1, 2, 1, 1.0, "2000-01-08"),  # three days allowed, four late
            line(1, 2, 1, 1.0, "2000-01-30", returned=False),
        ],
    )
    assert rows(films.films_most_often_late(s), "film_id", "late_returns", "actors") == [
        (1, 1, "fox, red"), (2, 1, "blue, fox")]
    assert rows(staff.store_with_highest_late_fees(s)) == [(0, 4.0)]
    assert rows(staff.staff_with_most_late_rentals(s)) == [(0, 2, None, None, None)]


def test_least_rented_actors_count_zero(shop):
    s = shop(orders=[order(1, 1, "2001-01-01")], lineitem=[line(1, 1, 1, 1.0, "2001-01-05")])
    assert rows(films.films_of_least_rented_actors(s)) == [("blue", 0, 2, "blue fox")]


def test_every_month_of_a_year(frame):
    data = [(1, f"2000-{m:02d}-01") for m in range(1, 13)] + [(2, f"2000-{m:02d}-01") for m in range(1, 12)]
    df = frame("film_id bigint, rental_date timestamp_ntz", data)
    assert rows(films.rented_every_month(df, "film_id")) == [(1, 2000)]


def test_peak_hours(shop):
    events = [(1, "2000-01-01 09:00", 1, "x", 0.0, ""), (2, "2000-01-01 09:30", 1, "x", 0.0, ""), (3, "2000-01-01 10:00", 2, "x", 0.0, "")]
    s = shop(events=events)
    assert rows(staff.staff_at_peak_hours(s, hours=1)) == [(0, 2)]
