"""Time between rentals, first and latest rentals, days out."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators import period
from reelmetrics.operators.gaps import latest, neighbours
from reelmetrics.operators.ranking import top, top_by_value
from reelmetrics.plans.periods import mean_days
from reelmetrics.plans.rankings import film_counts, with_titles
from reelmetrics.plans.registry import query

DAYS_OUT = """
t AS (SELECT customer_id, sum(epoch_us(return_date) - epoch_us(rental_date))::DOUBLE / 86400000000 AS days
      FROM rented GROUP BY customer_id),
r AS (SELECT customer_id, first_name, last_name, trunc(days)::BIGINT AS rented_duration
      FROM t JOIN cust USING (customer_id))
"""


def _days_out(shop, order):
    """One customer; the names are joined to that single row."""
    totals = shop.rented.groupBy("customer_id").agg(
        F.sum(d.exact_micros("return_date", "rental_date")).alias("micros")
    )
    chosen = (
        totals.select("customer_id", d.total_days(F.col("micros")).cast("long").alias("rented_duration"))
        .orderBy(order, "customer_id")
        .limit(1)
    )
    names = shop.customers.select("customer_id", "first_name", "last_name")
    return names.join(F.broadcast(chosen), "customer_id").select(
        "customer_id", "first_name", "last_name", "rented_duration"
    )


@query("q26", f"WITH {DAYS_OUT} SELECT * FROM r ORDER BY rented_duration NULLS FIRST, customer_id LIMIT 1")
def shortest_total_days_out(shop):
    return _days_out(shop, F.col("rented_duration").asc_nulls_first())


@query("q26_intent", f"WITH {DAYS_OUT} SELECT * FROM r ORDER BY rented_duration DESC NULLS LAST, customer_id LIMIT 1")
def longest_total_days_out(shop):
    return _days_out(shop, F.col("rented_duration").desc_nulls_last())


@query("q27", """
SELECT customer_id,
       trunc((epoch_us(max(rental_date)) - epoch_us(min(rental_date)))::DOUBLE / 86400000000)::BIGINT AS days_diff
FROM rental GROUP BY customer_id""")
def days_first_to_last_rental(shop):
    spans = shop.rentals.groupBy("customer_id").agg(
        F.min("rental_date").alias("first"), F.max("rental_date").alias("last")
    )
    return spans.select("customer_id", d.whole_days_between("last", "first").alias("days_diff")).orderBy(
        F.col("days_diff").desc(), "customer_id"
    )


def _rental_neighbours(shop):
    return neighbours(
        shop.rentals, ["customer_id"], "rental_date", "rental_id", "prev_rental_date", "next_rental_date"
    )


@query("q71", """
SELECT customer_id, rental_date, lag(rental_date) OVER w AS prev_rental_date,
       lead(rental_date) OVER w AS next_rental_date
FROM rental WINDOW w AS (PARTITION BY customer_id ORDER BY rental_date)""")
def previous_and_next_rental(shop):
    return _rental_neighbours(shop).select("customer_id", "rental_date", "prev_rental_date", "next_rental_date")


SINCE_PREVIOUS = """
SELECT customer_id, rental_date, lag(rental_date) OVER w AS prev_rental_date,
       round((epoch_us(rental_date) - epoch_us(lag(rental_date) OVER w))::DOUBLE / 86400000000, 2) AS diff
FROM rental WINDOW w AS (PARTITION BY customer_id ORDER BY rental_date)"""


@query("q72a", SINCE_PREVIOUS)
@query("q72b", SINCE_PREVIOUS)
def days_since_previous_rental(shop):
    return _rental_neighbours(shop).select(
        "customer_id",
        "rental_date",
        "prev_rental_date",
        F.round(d.days_between("rental_date", "prev_rental_date"), 2).alias("diff"),
    )


NEIGHBOUR_DAYS = """
n AS (SELECT customer_id, rental_date, lag(rental_date) OVER w AS prev_rental_date,
             lead(rental_date) OVER w AS next_rental_date
      FROM rental WINDOW w AS (PARTITION BY customer_id ORDER BY rental_date)),
g AS (SELECT *,
        trunc((epoch_us(rental_date) - epoch_us(prev_rental_date))::DOUBLE / 86400000000)::BIGINT AS days_since_prev,
        trunc((epoch_us(next_rental_date) - epoch_us(rental_date))::DOUBLE / 86400000000)::BIGINT AS days_until_next
      FROM n)
"""


@query("q86", f"WITH {NEIGHBOUR_DAYS} SELECT * FROM g")
def whole_days_to_neighbours(shop):
    return (
        _rental_neighbours(shop)
        .withColumn("days_since_prev", d.whole_days_between("rental_date", "prev_rental_date"))
        .withColumn("days_until_next", d.whole_days_between("next_rental_date", "rental_date"))
    )


@query("q87", f"""
WITH {NEIGHBOUR_DAYS}
SELECT customer_id, rental_date, prev_rental_date, days_since_prev AS gap FROM g WHERE days_since_prev > 30""")
def long_gaps(shop, more_than=30):
    return (
        _rental_neighbours(shop)
        .withColumn("gap", d.whole_days_between("rental_date", "prev_rental_date"))
        .filter(F.col("gap") > more_than)
        .select("customer_id", "rental_date", "prev_rental_date", "gap")
        .orderBy("gap", "customer_id", "rental_date")  # equal gaps spread over the tasks
    )


@query("q80", """
SELECT customer_id, max(rental_date) AS last_rental_date FROM rental
GROUP BY customer_id HAVING max(rental_date) < TIMESTAMP '2001-08-01' - INTERVAL 3 MONTH""")
def inactive_customers(shop, months=3):
    last = shop.rentals.groupBy("customer_id").agg(F.max("rental_date").alias("last_rental_date"))
    return last.filter(F.col("last_rental_date") < shop.months_ago(months))


@query("q88", """
WITH r AS (SELECT customer_id, rental_date,
                  row_number() OVER (PARTITION BY customer_id ORDER BY rental_date DESC, rental_id DESC) AS rn
           FROM rental)
SELECT customer_id, max(rental_date) FILTER (rn = 1) AS latest_rental,
       max(rental_date) FILTER (rn = 2) AS second_latest_rental
FROM r GROUP BY customer_id""")
def latest_two_rentals(shop):
    rows = shop.rentals.select("customer_id", "rental_date", "rental_id")
    two = latest(rows, ["customer_id"], [F.col("rental_date").desc(), F.col("rental_id").desc()], 2, "rn")
    return two.groupBy("customer_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("rental_date"))).alias("latest_rental"),
        F.max(F.when(F.col("rn") == 2, F.col("rental_date"))).alias("second_latest_rental"),
    )


@query("q93", """
WITH l AS (SELECT customer_id, film_id, rental_date,
                  lag(rental_date) OVER (PARTITION BY customer_id, film_id ORDER BY rental_date) AS prev_rental_date
           FROM rented)
SELECT *, trunc((epoch_us(rental_date) - epoch_us(prev_rental_date))::DOUBLE / 86400000000)::BIGINT AS days_between
FROM l WHERE prev_rental_date IS NOT NULL""")
def repeat_rentals_of_a_film(shop):
    out = neighbours(
        shop.rented, ["customer_id", "film_id"], "rental_date", "rental_id", "prev_rental_date",
    )
    return out.filter(F.col("prev_rental_date").isNotNull()).select(
        "customer_id",
        "film_id",
        "rental_date",
        "prev_rental_date",
        d.whole_days_between("rental_date", "prev_rental_date").alias("days_between"),
    )


@query("q94", """
WITH r AS (SELECT customer_id, rental_date, film_id,
  row_number() OVER (PARTITION BY customer_id ORDER BY rental_date, rental_id, film_id) AS f,
  row_number() OVER (PARTITION BY customer_id ORDER BY rental_date DESC, rental_id DESC, film_id DESC) AS l
  FROM rented)
SELECT customer_id,
       max(rental_date) FILTER (f = 1) AS first_rental_date, max(film_id) FILTER (f = 1) AS first_film_id,
       max(rental_date) FILTER (l = 1) AS last_rental_date, max(film_id) FILTER (l = 1) AS last_film_id
FROM r GROUP BY customer_id""")
def first_and_latest_rental(shop):
    films = shop.rented_copies.groupBy("rental_id").agg(F.min("film_id").alias("lo"), F.max("film_id").alias("hi"))
    per_rental = shop.rentals.join(films, "rental_id")
    # Two hash aggregates: the first and last rental of each moment, then the first and last moment.
    moments = per_rental.groupBy("customer_id", "rental_date").agg(
        F.min_by("lo", "rental_id").alias("lo"), F.max_by("hi", "rental_id").alias("hi")
    )
    ends = moments.groupBy("customer_id").agg(
        F.min("rental_date").alias("first_rental_date"),
        F.min_by("lo", "rental_date").alias("first_film_id"),
        F.max("rental_date").alias("last_rental_date"),
        F.max_by("hi", "rental_date").alias("last_film_id"),
    )
    return ends


@query("q95", """
WITH m AS (SELECT DISTINCT customer_id, year(rental_date) * 12 + month(rental_date) - 1 AS i FROM rental),
s AS (SELECT *, i - row_number() OVER (PARTITION BY customer_id ORDER BY i) AS island FROM m)
SELECT customer_id, strftime(make_date(min(i) // 12, min(i) % 12 + 1, 1), '%Y-%m') AS first_month,
       strftime(make_date(max(i) // 12, max(i) % 12 + 1, 1), '%Y-%m') AS last_month, count(*) AS months
FROM s GROUP BY customer_id, island HAVING count(*) >= 3""")
def customers_active_in_consecutive_months(shop, months=3):
    active = shop.rentals.select("customer_id", d.month_index("rental_date").alias("i"))
    return period.streaks(active, ["customer_id"], "i", months).select(
        "customer_id",
        d.year_month(d.index_month("first_index")).alias("first_month"),
        d.year_month(d.index_month("last_index")).alias("last_month"),
        F.col("length").alias("months"),
    )


@query("q97", """
SELECT film_id, title, count(*) AS rental_count,
       sum(epoch_us(return_date) - epoch_us(rental_date))::DOUBLE / 86400000000 / nullif(count(return_date), 0)
         AS avg_rental_duration
FROM rented JOIN film USING (film_id) GROUP BY film_id, title HAVING count(*) > 20""")
def mean_days_of_popular_films(shop, more_than=20):
    films = (
        shop.rented.groupBy("film_id")
        .agg(
            F.count("*").alias("rental_count"),
            F.count("return_date").alias("returned"),
            F.sum(d.exact_micros("return_date", "rental_date")).alias("micros"),
        )
        .filter(F.col("rental_count") > more_than)
    )
    return with_titles(films, shop).select(
        "film_id", "title", "rental_count", mean_days().alias("avg_rental_duration")
    )


@query("q98", """
WITH m AS (SELECT film_id, title, year(rental_date) * 12 + month(rental_date) - 1 AS i, count(*) AS n
           FROM rented JOIN film USING (film_id) GROUP BY ALL)
SELECT a.film_id, a.title, strftime(make_date(a.i // 12, a.i % 12 + 1, 1), '%Y-%m') AS year_month,
       a.n AS rental_count, b.n AS prev_month_count, a.n - b.n AS difference
FROM m a JOIN m b ON a.film_id = b.film_id AND a.i = b.i + 1
QUALIFY rank() OVER (ORDER BY a.n - b.n DESC) = 1""")
def largest_jump_between_months(shop):
    months = film_counts(shop.rented.withColumn("i", d.month_index("rental_date")), "i")
    jumps = (
        months.withColumn("prev_month_count", period.value_at(["film_id"], "i", "rental_count", -1))
        .withColumn("difference", F.col("rental_count") - F.col("prev_month_count"))
        .filter(F.col("difference").isNotNull())
    )
    best = top_by_value(jumps, [], "difference")
    return with_titles(best, shop).select(
        "film_id", "title", d.year_month(d.index_month("i")).alias("year_month"),
        "rental_count", "prev_month_count", "difference",
    )


@query("q100", """
SELECT film_id, shelf_id AS store_id, rental_date, lag(rental_date) OVER w AS prev_rental_date,
       lead(rental_date) OVER w AS next_rental_date
FROM rented WINDOW w AS (PARTITION BY film_id, shelf_id ORDER BY rental_date)""")
def previous_and_next_rental_per_film_and_store(shop):
    return neighbours(
        shop.shelf_rented, ["film_id", "store_id"], "rental_date", "rental_id",
        "prev_rental_date", "next_rental_date",
    )


@query("q108", """
WITH g AS (SELECT staff_id, epoch_us(rental_date)
                    - epoch_us(lag(rental_date) OVER (PARTITION BY staff_id ORDER BY rental_date)) AS gap
           FROM rental)
SELECT staff_id, max(gap)::DOUBLE / 86400000000 AS longest_gap_days FROM g GROUP BY staff_id
QUALIFY rank() OVER (ORDER BY max(gap) DESC) = 1""")
def staff_with_longest_gap(shop):
    # Equal dates add no gap, so distinct moments are enough and far fewer.
    moments = shop.staffed_rentals.select("staff_id", "rental_date").distinct()
    gaps = neighbours(moments, ["staff_id"], "rental_date", previous="prev").withColumn(
        "gap", d.days_between("rental_date", "prev")
    )
    longest = gaps.groupBy("staff_id").agg(F.max("gap").alias("longest_gap_days"))
    return top(longest, [], [F.col("longest_gap_days").desc_nulls_last()]).drop("rank")
