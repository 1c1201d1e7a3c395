from __future__ import annotations

from pyspark.sql import functions as F

from conftest import line, order, rows
from reelmetrics.functions import dates as d
from reelmetrics.operators import period
from reelmetrics.plans import periods, running


def test_zero_previous_gives_null(frame):
    df = frame("y bigint, v bigint", [(1, 0), (2, 5), (3, 10)])
    out = period.with_previous(df, [], ["y"], "v", "prev").withColumn("pct", d.percent_change(F.col("v"), F.col("prev")))
    assert rows(out, "y", "pct") == [(1, None), (2, None), (3, 100.0)]


def test_first_period(shop):
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 1, 4.0, "2000-01-05")])
    assert rows(periods.revenue_change_per_staff_month(s), "change") == [(None,)]
    assert rows(periods.revenue_change_per_staff_month_or_zero(s), "mom_change") == [(0.0,)]


def test_bound_date_is_excluded_with_its_times(shop):
    s = shop(orders=[order(1, 1, "2000-12-31 23:59"), order(2, 1, "2001-01-01"), order(3, 1, "2001-01-01 10:00")])
    assert rows(periods.rentals_change_per_month(s), "month", "total_rents") == [("2000-12", 1)]


def test_rental_with_two_payments_counts_once(shop):
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 1, 4.0, "2000-01-05"), line(1, 2, 1, 3.0, "2000-01-06")])
    assert rows(periods.revenue_change_per_store_month(s), "total_rents", "rental_revenue") == [(1, 7.0)]


def test_rows_frame_takes_present_months(shop):
    dates = ["2000-01-01", "2000-02-01", "2000-05-01"]
    s = shop(
        orders=[order(i, 1, x) for i, x in enumerate(dates)],
        lineitem=[line(i, 1, 1, 1.0, "2000-06-01") for i in range(3)] + [line(2, 1, 1, 1.0, "2000-06-01")],
    )
    out = rows(periods.rolling_rentals_per_category(s, months=2), "year_month", "rolling_avg")
    assert out == [("2000-01", 1.0), ("2000-02", 1.0), ("2000-05", 1.5)]


def test_exact_offset_ignores_absent_periods(frame):
    df = frame("i bigint, v bigint", [(1, 10), (2, 20), (5, 50)])
    out = df.withColumn("prev", period.value_at([], "i", "v", -1))
    assert rows(out, "i", "prev") == [(1, None), (2, 10), (5, None)]


def test_growth_year_decides_best_month(shop):
    lines = [line(1, 1, 1, a, x) for a, x in [(50.0, "1999-01-05"), (40.0, "2000-02-05"), (30.0, "2001-03-05"), (25.0, "2001-04-05")]]
    s = shop(orders=[order(1, 1, "1999-01-01")], lineitem=lines)
    assert rows(periods.best_month_in_growth_years(s)) == [(0, "2001-03", 30.0)]
    assert rows(periods.best_month_per_store(s)) == [(0, "1999-01", 50.0)]


def test_decades_and_quarters(frame):
    df = frame("t timestamp_ntz", [("1999-12-31",), ("2000-01-01",)])
    out = df.select(d.decade(F.year("t")).alias("d"), d.quarter_index("t").alias("q"), d.month_text("t").alias("m"))
    assert [tuple(r) for r in out.collect()] == [(1990, 7999, "12"), (2000, 8000, "01")]


def test_month_index_round_trip(frame):
    df = frame("t timestamp_ntz", [("1999-12-31",), ("2000-01-01",)])
    out = df.select(d.year_month(d.index_month(d.month_index("t"))).alias("m"))
    assert [r.m for r in out.collect()] == ["1999-12", "2000-01"]


def test_running_queries_use_decimals(shop):
    """0.1 + 0.2 stays 0.3: money is summed as decimal."""
    s = shop(orders=[order(1, 1, "2000-01-01")], lineitem=[line(1, 1, 1, 0.1, "2000-01-05"), line(1, 1, 1, 0.2, "2000-01-06")])
    assert rows(running.revenue_to_date_per_store(s), "cumulative_revenue") == [(0.1,), (0.3,)]
