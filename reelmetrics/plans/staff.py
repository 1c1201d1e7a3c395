"""Staff revenue, peak hours, late rentals and fees."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators.ranking import first_against_second, first_and_second, top
from reelmetrics.plans.films import _with_allowance, is_late
from reelmetrics.plans.registry import query


def staff_revenue(shop, *keys):
    return shop.store_payments.groupBy(*keys).agg(F.sum("amount").alias("revenue"))


def _best(df, by):
    best = top(df, by, [F.col("revenue").desc()]).drop("rank")
    return best.withColumn("revenue", F.col("revenue").cast("double"))


@query("q15", """
SELECT strftime(payment_date, '%Y') AS payment_year, staff_id, sum(amount)::DOUBLE AS revenue
FROM payment GROUP BY strftime(payment_date, '%Y'), staff_id
QUALIFY rank() OVER (PARTITION BY strftime(payment_date, '%Y') ORDER BY sum(amount) DESC) = 1""")
def best_staff_per_year(shop):
    years = shop.store_payments.withColumn("payment_year", F.year("payment_date"))
    revenue = years.groupBy("payment_year", "staff_id").agg(F.sum("amount").alias("revenue"))
    return _best(revenue, ["payment_year"]).withColumn("payment_year", F.col("payment_year").cast("string"))


@query("q61", """
SELECT staff_id, sum(amount)::DOUBLE AS revenue FROM payment GROUP BY staff_id
QUALIFY rank() OVER (ORDER BY sum(amount) DESC) = 1""")
def staff_with_highest_revenue(shop):
    return _best(staff_revenue(shop, "staff_id"), [])


@query("q62", "SELECT store_id, staff_id, sum(amount)::DOUBLE AS revenue FROM payment GROUP BY ALL")
def revenue_per_staff_and_store(shop):
    revenue = staff_revenue(shop, "store_id", "staff_id")
    return revenue.withColumn("revenue", F.col("revenue").cast("double"))


@query("q106", """
SELECT store_id, staff_id, sum(amount)::DOUBLE AS revenue FROM payment GROUP BY store_id, staff_id
QUALIFY rank() OVER (PARTITION BY store_id ORDER BY sum(amount) DESC) = 1""")
def best_staff_per_store(shop):
    return _best(staff_revenue(shop, "store_id", "staff_id"), ["store_id"])


@query("q63", """
WITH h AS (SELECT hour(ts) AS h, count(*) AS n FROM timed GROUP BY ALL),
peak AS (SELECT h FROM h ORDER BY n DESC, h LIMIT 3)
SELECT staff_id, count(*) AS peak_rentals FROM timed WHERE hour(ts) IN (SELECT h FROM peak) GROUP BY staff_id
QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1""")
def staff_at_peak_hours(shop, hours=3):
    per_hour = shop.timed_rentals.groupBy(F.hour("ts").alias("hour"), "staff_id").agg(F.count("*").alias("n"))
    peak = (
        per_hour.groupBy("hour")
        .agg(F.sum("n").alias("total"))
        .orderBy(F.col("total").desc(), "hour")
        .limit(hours)
        .select("hour")
    )
    served = per_hour.join(F.broadcast(peak), "hour", "left_semi")
    counts = served.groupBy("staff_id").agg(F.sum("n").alias("peak_rentals"))
    return top(counts, [], [F.col("peak_rentals").desc()]).drop("rank")


@query("q65", """
WITH f AS (
  SELECT store_id, sum(greatest(trunc((epoch_us(return_date) - epoch_us(rental_date))::DOUBLE / 86400000000)::BIGINT
                                - allowed_days, 0) * 1.00) AS late_fees
  FROM rented JOIN film USING (film_id) WHERE return_date IS NOT NULL GROUP BY store_id)
SELECT store_id, late_fees::DOUBLE AS late_fees FROM f QUALIFY rank() OVER (ORDER BY late_fees DESC) = 1""")
def store_with_highest_late_fees(shop, fee="1.00"):
    late_days = F.greatest(
        d.whole_days_between("return_date", "rental_date") - F.col("allowed_days"), F.lit(0).cast("long")
    )
    fees = (
        _with_allowance(shop.rented_staff, shop)
        .groupBy("store_id")
        .agg((F.sum(late_days) * F.lit(fee).cast("decimal(18,2)")).alias("late_fees"))
    )
    best = top(fees, [], [F.col("late_fees").desc()]).drop("rank")
    return best.withColumn("late_fees", F.col("late_fees").cast("double"))


@query("q110", """
WITH c AS (
  SELECT staff_id, count(*) AS n FROM rented JOIN film USING (film_id)
  WHERE epoch_us(return_date) - epoch_us(rental_date) > allowed_days * 86400000000 GROUP BY staff_id),
r AS (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS rank FROM c)
SELECT a.staff_id AS top_staff_id, a.n AS top_late_rentals, b.staff_id AS second_staff_id,
       b.n AS second_late_rentals, a.n - b.n AS difference
FROM r a LEFT JOIN r b ON b.rank = 2 WHERE a.rank = 1""")
def staff_with_most_late_rentals(shop):
    late = _with_allowance(shop.rented_staff, shop).filter(is_late())
    counts = late.groupBy("staff_id").agg(F.count("*").alias("n"))
    return first_against_second(
        counts, [], "n",
        {"staff_id": "top_staff_id", "n": "top_late_rentals"},
        {"staff_id": "second_staff_id", "n": "second_late_rentals"},
        "difference",
    )


@query("q110_intent", """
WITH c AS (
  SELECT staff_id, count(*) AS n FROM rented JOIN film USING (film_id)
  WHERE epoch_us(return_date) - epoch_us(rental_date) > allowed_days * 86400000000 GROUP BY staff_id),
listed AS (SELECT list({'id': staff_id, 'n': n} ORDER BY n DESC, staff_id) AS l FROM c)
SELECT l[1].id AS top_staff_id, l[1].n AS top_late_rentals, l[2].id AS second_staff_id,
       l[2].n AS second_late_rentals, l[1].n - l[2].n AS difference
FROM listed WHERE l IS NOT NULL""")
def staff_with_most_late_rentals_and_the_next(shop):
    """One row; of staff with equal counts the smaller number comes first."""
    late = _with_allowance(shop.rented_staff, shop).filter(is_late())
    counts = late.groupBy("staff_id").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return first_and_second(
        counts, ["all"], "n", "staff_id",
        {"staff_id": "top_staff_id", "n": "top_late_rentals"},
        {"staff_id": "second_staff_id", "n": "second_late_rentals"},
        "difference",
    ).drop("all")
