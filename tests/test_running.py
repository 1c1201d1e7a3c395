from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import line, order, rows, ts
from reelmetrics.operators.running import running_total, running_total_with_reset
from reelmetrics.plans import running as plans

PAY = "k bigint, t timestamp_ntz, v bigint"


def test_tied_dates_share_the_later_total(frame):
    df = frame(PAY, [(1, "2000-01-01", 5), (1, "2000-01-01", 7), (1, "2000-01-02", 1)])
    out = rows(running_total(df, ["k"], "t", F.col("v"), "total"), "v", "total")
    assert out == [(1, 13), (5, 12), (7, 12)]


def random_events(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = rng.choice([1, 1, 1, 2, 3, None])
        day, hour = rng.randint(1, 28), rng.choice([0, 0, 9, 17])
        moment = None if rng.random() < 0.03 else f"2000-0{rng.randint(1, 9)}-{day:02d} {hour:02d}:00"
        out.append((key, moment, None if rng.random() < 0.05 else rng.randint(-5, 9)))
    return out


def test_same_as_plain_window(frame):
    df = frame(PAY, random_events(1))
    want = df.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("t")))
    assert rows(running_total(df, ["k"], "t", F.col("v"), "total")) == rows(want)


def test_nearly_all_rows_have_a_null_key(frame):
    events = [(None if i % 100 else 1, t, v) for i, (_, t, v) in enumerate(random_events(9, 1000))]
    df = frame(PAY, events)
    want = df.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("t")))
    assert rows(running_total(df, ["k"], "t", F.col("v"), "total")) == rows(want)


def test_last_running_total_is_the_group_sum(frame):
    df = frame(PAY, random_events(2))
    out = running_total(df, ["k"], "t", F.col("v"), "total")
    last = out.groupBy("k").agg(F.max_by("total", "t").alias("last"))
    sums = df.groupBy("k").agg(F.sum("v").alias("last"))
    assert rows(last, "k", "last") == rows(sums, "k", "last")


def gap(days):
    return lambda previous, current: F.timestamp_diff("SECOND", previous, current) > days * 86400


def test_reset_needs_more_than_the_gap(frame):
    df = frame(PAY, [
        (1, "2000-01-01", 1), (1, "2000-03-31", 2),  # exactly 90 days: goes on
        (2, "2000-01-01", 1), (2, "2000-03-31 12:00", 2),  # 90.5 days: starts again
    ])
    out = running_total_with_reset(df, ["k"], "t", F.col("v"), gap(90), "total")
    assert rows(out, "k", "v", "total") == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 2)]


def brute_reset(events, days):
    out = []
    for key in {k for k, _, _ in events}:
        mine = sorted((ts(t), v) for k, t, v in events if k == key)
        start = 0
        for i, (t, v) in enumerate(mine):
            if i and (t - mine[i - 1][0]).total_seconds() > days * 86400:
                start = i
            peers = [x for x in mine[start:] if x[0] <= t]
            out.append((key, t, v, sum(x[1] for x in peers)))
    return sorted(out)


def test_reset_same_as_brute_force(frame):
    for seed in (3, 4):
        events = [(k, t, v) for k, t, v in random_events(seed, 150) if None not in (k, t, v)]
        df = frame(PAY, events)
        out = running_total_with_reset(df, ["k"], "t", F.col("v"), gap(5), "total")
        assert sorted(map(tuple, out.select("k", "t", "v", "total").collect())) == brute_reset(events, 5)


def test_unmatched_copy_is_kept_under_null(shop):
    dates = ["2000-01-01", "2000-01-02", "2000-01-03", "2000-01-03"]
    s = shop(
        orders=[order(i, 1, t) for i, t in enumerate(dates)],
        lineitem=[line(i, film, 1, 1.0, "2000-02-01") for i, film in enumerate([1, 9, 8, 1])],
    )
    out = plans.rentals_to_date_per_film(s)
    assert rows(out, "film_id", "cum_total_rentals") == [(None, 1), (None, 2), (1, 1), (1, 2)]


def test_payments_restart_each_year(shop):
    s = shop(
        orders=[order(10, 1, "1999-12-01")],
        lineitem=[line(10, 1, 1, 2.0, "1999-12-30"), line(10, 1, 1, 3.0, "1999-12-31"), line(10, 2, 1, 4.0, "2000-01-01")],
    )
    out = plans.payments_to_date_per_customer_year(s)
    assert [r[1] for r in rows(out, "payment_date", "running_total_payments")] == [2.0, 5.0, 4.0]


def test_only_customers_with_more_than_five_rentals_count(shop):
    six = [order(i, 1, f"2000-01-0{i}") for i in range(1, 7)]
    five = [order(10 + i, 2, f"2000-01-0{i}") for i in range(1, 6)]
    lines = [line(o[0], 1, 1, 1.0, "2000-02-01") for o in six + five]
    s = shop(orders=six + five, lineitem=lines)
    assert [r[0] for r in rows(plans.rentals_to_date_per_copy_regulars(s), "cumm_running_total_film")] == [1, 2, 3, 4, 5, 6]


def test_rolling_window_counts_missing_months_as_empty(shop):
    lines = [line(1, 1, 1, 10.0, d) for d in ("2000-01-05", "2000-02-05", "2000-05-05")]
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=lines)
    out = plans.rolling_revenue_before_month(s)
    assert rows(out, "revenue_month", "rolling_3_month_revenue") == [
        (1, None), (2, 10.0), (3, 20.0), (4, 20.0), (5, 10.0)]
    mean = rows(plans.rolling_mean_revenue(s), "revenue_month", "rolling_avg_revenue")
    assert mean[4] == (5, 10 / 3)
