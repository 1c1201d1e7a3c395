"""Totals per month, quarter and year, and their change."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators import period, ranking
from reelmetrics.plans.registry import query
from reelmetrics.plans.running import store_months


@query("q6", """
SELECT strftime(rental_date, '%Y') AS "Year", strftime(rental_date, '%m') AS "Month", count(*) AS total_rents
FROM rental WHERE year(rental_date) = 2000 GROUP BY ALL""")
def rentals_per_month_of_year(shop, year=None):
    year = year or shop.year
    # A range on the column reaches the Parquet scan; year(rental_date) = 2000 would not.
    first = F.make_timestamp_ntz(*[F.lit(v) for v in (year, 1, 1, 0, 0, 0)])
    after = F.make_timestamp_ntz(*[F.lit(v) for v in (year + 1, 1, 1, 0, 0, 0)])
    return (
        shop.rentals.filter((F.col("rental_date") >= first) & (F.col("rental_date") < after))
        .groupBy(d.month_start("rental_date").alias("month"))
        .agg(F.count("*").alias("total_rents"))
        .select(d.year_text("month").alias("Year"), d.month_text("month").alias("Month"), "total_rents")
    )


def rental_days(rows, *keys):
    """Mean days out of returned copies per key, summed exactly."""
    return rows.groupBy(*keys).agg(
        F.sum(d.exact_micros("return_date", "rental_date")).alias("micros"),
        F.count("return_date").alias("returned"),
    )


def mean_days():
    return d.ratio(d.total_days(F.col("micros")), F.col("returned"))


@query("q7", """
SELECT category_id,
       sum(epoch_us(return_date) - epoch_us(rental_date))::DOUBLE / 86400000000 / count(*)
         AS avg_rental_duration_days
FROM rented JOIN film_cat USING (film_id) WHERE return_date IS NOT NULL GROUP BY category_id""")
def mean_days_per_category(shop):
    rows = shop.rented.filter(F.col("return_date").isNotNull()).join(shop.film_category, "film_id")
    return rental_days(rows, "category_id").select(
        "category_id", mean_days().alias("avg_rental_duration_days")
    )


@query("q10", """
SELECT store_id, strftime(payment_date, '%Y') AS year, quarter(payment_date) AS quarter,
       sum(amount)::DOUBLE AS total_revenue
FROM payment GROUP BY ALL""")
def revenue_per_store_quarter(shop):
    return (
        shop.store_payments.groupBy("store_id", d.quarter_index("payment_date").alias("q"))
        .agg(F.sum("amount").alias("revenue"))
        .select(
            "store_id",
            F.floor(F.col("q") / 4).cast("string").alias("year"),
            (F.col("q") % 4 + 1).alias("quarter"),
            F.col("revenue").cast("double").alias("total_revenue"),
        )
        .orderBy("store_id", "year", "quarter")
    )


@query("q16", """
WITH y AS (SELECT strftime(payment_date, '%Y') AS "Year", count(rental_id) AS total_rents, sum(amount) AS revenue
           FROM payment GROUP BY ALL)
SELECT "Year", total_rents,
       (revenue - lag(revenue) OVER (ORDER BY "Year"))::DOUBLE
         / nullif((lag(revenue) OVER (ORDER BY "Year"))::DOUBLE, 0) * 100 AS "YOy_change"
FROM y""")
def revenue_change_per_year(shop):
    years = shop.takings.groupBy(F.year("payment_date").alias("y")).agg(
        F.count("rental_id").alias("total_rents"), F.sum("amount").alias("revenue")
    )
    with_prev = period.with_previous(years, [], ["y"], "revenue", "prev")
    return with_prev.select(
        F.col("y").cast("string").alias("Year"),
        "total_rents",
        d.percent_change(F.col("revenue"), F.col("prev")).alias("YOy_change"),
    )


def _monthly_rentals(rows):
    return rows.groupBy(d.month_start("rental_date").alias("m")).agg(F.count("rental_id").alias("total_rents"))


@query("q17", """
WITH m AS (SELECT strftime(rental_date, '%Y-%m') AS month, count(rental_id) AS total_rents
           FROM rental WHERE rental_date < TIMESTAMP '2001-01-01' GROUP BY ALL)
SELECT month, total_rents, lag(total_rents) OVER (ORDER BY month) AS prev_month_rents,
       total_rents - lag(total_rents) OVER (ORDER BY month) AS mom_change
FROM m""")
def rentals_change_per_month(shop, before=None):
    # Text order puts a bare date before every time of that date, so the bound itself is excluded.
    bound = F.lit(before or shop.before).cast("timestamp_ntz")
    months = _monthly_rentals(shop.rentals.filter(F.col("rental_date") < bound))
    return (
        period.with_previous(months, [], ["m"], "total_rents", "prev_month_rents")
        .select(
            d.year_month("m").alias("month"),
            "total_rents",
            "prev_month_rents",
            (F.col("total_rents") - F.col("prev_month_rents")).alias("mom_change"),
        )
        .orderBy("month")
    )


@query("q17_intent", """
WITH m AS (
  SELECT date_trunc('month', rental_date) AS m, count(*) AS total_rents
  FROM rental
  WHERE rental_date >= TIMESTAMP '2000-08-01' AND rental_date <= TIMESTAMP '2001-08-01' GROUP BY ALL),
c AS (SELECT *, lag(total_rents) OVER (ORDER BY m) AS prev_month_rents FROM m)
SELECT strftime(m, '%Y-%m') AS month, total_rents, prev_month_rents,
       total_rents - prev_month_rents AS mom_change
FROM c WHERE m > TIMESTAMP '2000-08-01'""")
def rentals_change_last_twelve_months(shop):
    first = F.trunc(shop.months_ago(12), "month")
    date = F.col("rental_date")
    months = _monthly_rentals(
        shop.rentals.filter((date >= first.cast("timestamp_ntz")) & (date <= shop.today))
    )
    return (
        period.with_previous(months, [], ["m"], "total_rents", "prev_month_rents")
        .filter(F.col("m") > first)
        .select(
            d.year_month("m").alias("month"),
            "total_rents",
            "prev_month_rents",
            (F.col("total_rents") - F.col("prev_month_rents")).alias("mom_change"),
        )
        .orderBy("month")
    )


@query("q18", """
WITH y AS (SELECT strftime(rental_date, '%Y') AS rental_year, category_id, count(rental_id) AS total_rents
           FROM rented JOIN film_cat USING (film_id) GROUP BY ALL)
SELECT rental_year, category_id, total_rents,
       lag(total_rents) OVER w AS prev_year_total_rents,
       total_rents - lag(total_rents) OVER w AS yoy_change_total
FROM y WINDOW w AS (PARTITION BY category_id ORDER BY rental_year)""")
def rentals_change_per_category_year(shop):
    years = (
        shop.rented.join(shop.film_category, "film_id")
        .groupBy(F.year("rental_date").alias("y"), "category_id")
        .agg(F.count("rental_id").alias("total_rents"))
    )
    return period.with_previous(years, ["category_id"], ["y"], "total_rents", "prev_year_total_rents").select(
        F.col("y").cast("string").alias("rental_year"),
        "category_id",
        "total_rents",
        "prev_year_total_rents",
        (F.col("total_rents") - F.col("prev_year_total_rents")).alias("yoy_change_total"),
    )


@query("q19", """
WITH m AS (SELECT strftime(payment_date, '%Y') AS payment_year, strftime(payment_date, '%m') AS payment_month,
                  sum(amount) AS total_revenue
           FROM payment GROUP BY ALL)
SELECT payment_year, payment_month, total_revenue::DOUBLE AS total_revenue,
       (total_revenue - lag(total_revenue) OVER (PARTITION BY payment_month ORDER BY payment_year))::DOUBLE
         AS prev_month_revenue_change
FROM m""")
def revenue_same_month_other_years(shop):
    months = (
        shop.takings.groupBy(d.month_start("payment_date").alias("m"))
        .agg(F.sum("amount").alias("revenue"))
        .withColumn("month", F.month("m"))
    )
    return period.with_previous(months, ["month"], ["m"], "revenue", "prev").select(
        d.year_text("m").alias("payment_year"),
        d.month_text("m").alias("payment_month"),
        F.col("revenue").cast("double").alias("total_revenue"),
        (F.col("revenue") - F.col("prev")).cast("double").alias("prev_month_revenue_change"),
    )


@query("q20", """
WITH m AS (
  SELECT renting_store_id AS store_id, date_trunc('month', rental_date) AS m,
         count(DISTINCT rental_id) AS total_rents, sum(amount) AS revenue
  FROM payment WHERE renting_store_id IS NOT NULL GROUP BY ALL)
SELECT store_id, strftime(m, '%m') AS rental_month, strftime(m, '%Y') AS rental_year, total_rents,
       revenue::DOUBLE AS rental_revenue, (lag(revenue) OVER w)::DOUBLE AS lag_revenue,
       (revenue - lag(revenue) OVER w)::DOUBLE AS revenue_change
FROM m WINDOW w AS (PARTITION BY store_id ORDER BY m)""")
def revenue_change_per_store_month(shop):
    # Payments are summed per rental before the join, so several payments count one rental.
    paid = shop.takings.groupBy("rental_id").agg(F.sum("amount").alias("paid"))
    months = (
        shop.staffed_rentals.join(paid, "rental_id")
        .groupBy("store_id", d.month_start("rental_date").alias("m"))
        .agg(F.count("*").alias("total_rents"), F.sum("paid").alias("revenue"))
    )
    return period.with_previous(months, ["store_id"], ["m"], "revenue", "prev").select(
        "store_id",
        d.month_text("m").alias("rental_month"),
        d.year_text("m").alias("rental_year"),
        "total_rents",
        F.col("revenue").cast("double").alias("rental_revenue"),
        F.col("prev").cast("double").alias("lag_revenue"),
        (F.col("revenue") - F.col("prev")).cast("double").alias("revenue_change"),
    )


@query("q28", """
WITH m AS (SELECT store_id, year(payment_date) AS y, strftime(payment_date, '%Y-%m') AS rental_month,
                  sum(amount) AS revenue
           FROM payment GROUP BY ALL),
y AS (SELECT store_id, y, sum(revenue) AS revenue FROM m GROUP BY ALL),
growth AS (SELECT cur.store_id, cur.y FROM y cur JOIN y prev
           ON cur.store_id = prev.store_id AND cur.y = prev.y + 1 AND cur.revenue > prev.revenue)
SELECT store_id, rental_month, revenue::DOUBLE AS rental_revenue
FROM m JOIN growth USING (store_id, y)
QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, rental_month) = 1""")
def best_month_in_growth_years(shop):
    months = store_months(shop).withColumn("y", F.year("month"))
    growing = (
        months.withColumn("this_year", period.value_at(["store_id"], "y", "revenue", 0))
        .withColumn("last_year", period.value_at(["store_id"], "y", "revenue", -1))
        .filter(F.col("this_year") > F.col("last_year"))
    )
    return _best_month(growing)


@query("q114", """
SELECT store_id, strftime(payment_date, '%Y-%m') AS rental_month, sum(amount)::DOUBLE AS rental_revenue
FROM payment GROUP BY store_id, strftime(payment_date, '%Y-%m')
QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY sum(amount) DESC, strftime(payment_date, '%Y-%m')) = 1""")
def best_month_per_store(shop):
    return _best_month(store_months(shop))


def _best_month(months):
    best = ranking.top(months, ["store_id"], [F.col("revenue").desc(), F.col("month")], 1, "row")
    return best.select(
        "store_id",
        d.year_month("month").alias("rental_month"),
        F.col("revenue").cast("double").alias("rental_revenue"),
    ).orderBy("store_id")


@query("q30", """
WITH q AS (SELECT year(payment_date) AS revenue_year, quarter(payment_date) AS revenue_quarter,
                  sum(amount) AS revenue
           FROM payment GROUP BY ALL),
c AS (SELECT *, revenue - lag(revenue) OVER (ORDER BY revenue_year, revenue_quarter) AS change FROM q)
SELECT revenue_year, revenue_quarter, revenue::DOUBLE AS total_revenue, change::DOUBLE AS revenue_change
FROM c ORDER BY change DESC NULLS LAST, revenue_year, revenue_quarter LIMIT 1""")
def quarter_with_largest_rise(shop):
    quarters = shop.takings.groupBy(d.quarter_index("payment_date").alias("q")).agg(F.sum("amount").alias("revenue"))
    return (
        period.with_previous(quarters, [], ["q"], "revenue", "prev")
        .withColumn("change", F.col("revenue") - F.col("prev"))
        .orderBy(F.col("change").desc_nulls_last(), "q")
        .limit(1)
        .select(
            F.floor(F.col("q") / 4).alias("revenue_year"),
            (F.col("q") % 4 + 1).alias("revenue_quarter"),
            F.col("revenue").cast("double").alias("total_revenue"),
            F.col("change").cast("double").alias("revenue_change"),
        )
    )


@query("q35", """
WITH m AS (SELECT category_id, strftime(rental_date, '%Y-%m') AS year_month, count(rental_id) AS rental_count
           FROM rented JOIN film_cat USING (film_id) GROUP BY ALL)
SELECT category_id, year_month, rental_count,
       avg(rental_count) OVER (PARTITION BY category_id ORDER BY year_month
                               ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_avg
FROM m""")
def rolling_rentals_per_category(shop, months=6):
    counts = (
        shop.rented.join(shop.film_category, "film_id")
        .groupBy("category_id", d.month_start("rental_date").alias("m"))
        .agg(F.count("rental_id").alias("rental_count"))
        .withColumn("rn", ranking.small_rank(["category_id"], [F.col("m")], "row"))
    )
    w = period.series(["category_id"], "rn").rowsBetween(1 - months, 0)
    return counts.select(
        "category_id",
        d.year_month("m").alias("year_month"),
        "rental_count",
        F.avg("rental_count").over(w).alias("rolling_avg"),
    )


def _store_year_growth(shop):
    years = shop.staffed_rentals.groupBy("store_id", d.year_number("rental_date").alias("rental_year")).agg(
        F.count("*").alias("rental_count")
    )
    with_prev = period.with_previous(years, ["store_id"], ["rental_year"], "rental_count", "prev_year_count")
    change = d.ratio((F.col("rental_count") - F.col("prev_year_count")) * F.lit(100.0), F.col("prev_year_count"))
    return with_prev.withColumn("yoy_pct_change", F.round(change, 2))


STORE_YEAR_GROWTH = """
y AS (SELECT store_id, year(rental_date) AS rental_year, count(*) AS rental_count FROM rental GROUP BY ALL),
l AS (SELECT *, lag(rental_count) OVER (PARTITION BY store_id ORDER BY rental_year) AS prev_year_count FROM y),
g AS (SELECT *, round((rental_count - prev_year_count) * 100.0::DOUBLE / prev_year_count, 2) AS yoy_pct_change
      FROM l)
"""


@query("q36", f"WITH {STORE_YEAR_GROWTH} SELECT * FROM g")
def rental_growth_per_store(shop):
    return _store_year_growth(shop).orderBy(F.col("yoy_pct_change").desc())


@query("q36_intent", f"""
WITH {STORE_YEAR_GROWTH}
SELECT * FROM g WHERE yoy_pct_change = (SELECT max(yoy_pct_change) FROM g)""")
def store_with_highest_growth(shop):
    known = _store_year_growth(shop).filter(F.col("yoy_pct_change").isNotNull())
    return ranking.top(known, [], [F.col("yoy_pct_change").desc()]).drop("rank")


def _staff_months(shop):
    return shop.store_payments.groupBy("staff_id", d.month_start("payment_date").alias("m")).agg(
        F.sum("amount").alias("revenue")
    )


@query("q37a", """
WITH m AS (SELECT staff_id, date_trunc('month', payment_date) AS m, sum(amount) AS revenue
           FROM payment GROUP BY ALL)
SELECT staff_id, strftime(m, '%Y') AS payment_year, strftime(m, '%m') AS payment_month,
       revenue::DOUBLE AS total_revenue, (lag(revenue) OVER w)::DOUBLE AS lag_rental_revenue,
       (revenue - lag(revenue) OVER w)::DOUBLE AS change
FROM m WINDOW w AS (PARTITION BY staff_id ORDER BY m)""")
def revenue_change_per_staff_month(shop):
    return period.with_previous(_staff_months(shop), ["staff_id"], ["m"], "revenue", "prev").select(
        "staff_id",
        d.year_text("m").alias("payment_year"),
        d.month_text("m").alias("payment_month"),
        F.col("revenue").cast("double").alias("total_revenue"),
        F.col("prev").cast("double").alias("lag_rental_revenue"),
        (F.col("revenue") - F.col("prev")).cast("double").alias("change"),
    )


@query("q37b", """
WITH m AS (SELECT staff_id, date_trunc('month', payment_date) AS m, sum(amount) AS revenue
           FROM payment GROUP BY ALL)
SELECT staff_id, strftime(m, '%Y-%m') AS payment_year_month, revenue::DOUBLE AS revenue,
       (lag(revenue) OVER w)::DOUBLE AS prev_mon_revenue,
       coalesce(revenue - lag(revenue) OVER w, 0)::DOUBLE AS mom_change
FROM m WINDOW w AS (PARTITION BY staff_id ORDER BY m)""")
def revenue_change_per_staff_month_or_zero(shop):
    return period.with_previous(_staff_months(shop), ["staff_id"], ["m"], "revenue", "prev").select(
        "staff_id",
        d.year_month("m").alias("payment_year_month"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("prev").cast("double").alias("prev_mon_revenue"),
        F.coalesce(F.col("revenue") - F.col("prev"), F.lit(0)).cast("double").alias("mom_change"),
    )


@query("q38", """
WITH y AS (
  SELECT category_id, year(rental_date) AS rental_year,
         sum(epoch_us(return_date) - epoch_us(rental_date))::DOUBLE / 86400000000
           / nullif(count(return_date), 0) AS avg_rental_duration
  FROM rented JOIN film_cat USING (film_id) GROUP BY ALL)
SELECT *, avg_rental_duration - lag(avg_rental_duration) OVER (PARTITION BY category_id ORDER BY rental_year)
            AS yoy_change
FROM y""")
def mean_days_change_per_category_year(shop):
    rows = shop.rented.join(shop.film_category, "film_id").withColumn("rental_year", d.year_number("rental_date"))
    years = rental_days(rows, "category_id", "rental_year").select(
        "category_id", "rental_year", mean_days().alias("avg_rental_duration")
    )
    with_prev = period.with_previous(years, ["category_id"], ["rental_year"], "avg_rental_duration", "prev")
    return (
        with_prev.withColumn("yoy_change", F.col("avg_rental_duration") - F.col("prev"))
        .drop("prev")
        .orderBy("category_id", "rental_year")
    )


SAME_MONTH = """
m AS (SELECT month(rental_date) AS rental_month, year(rental_date) AS rental_year, count(*) AS rental_count
      FROM rental GROUP BY ALL),
c AS (SELECT *, rental_count - lag(rental_count) OVER (PARTITION BY rental_month ORDER BY rental_year)
        AS diff_from_prev_year FROM m)
"""


def _same_month_change(shop):
    months = (
        shop.rentals.groupBy(d.month_start("rental_date").alias("m"))
        .agg(F.count("*").alias("rental_count"))
        .select(d.month_number("m").alias("rental_month"), d.year_number("m").alias("rental_year"), "rental_count")
    )
    return (
        period.with_previous(months, ["rental_month"], ["rental_year"], "rental_count", "prev")
        .withColumn("diff_from_prev_year", F.col("rental_count") - F.col("prev"))
        .drop("prev")
    )


def _lowest(changes):
    order = [F.col("diff_from_prev_year").asc_nulls_first(), F.col("rental_year"), F.col("rental_month")]
    return changes.orderBy(*order).limit(1)


@query("q39", f"""
WITH {SAME_MONTH}
SELECT * FROM c ORDER BY diff_from_prev_year NULLS FIRST, rental_year, rental_month LIMIT 1""")
def first_month_by_change(shop):
    return _lowest(_same_month_change(shop))


@query("q39_intent", f"""
WITH {SAME_MONTH}
SELECT * FROM c WHERE diff_from_prev_year IS NOT NULL
ORDER BY diff_from_prev_year, rental_year, rental_month LIMIT 1""")
def month_with_biggest_drop(shop):
    return _lowest(_same_month_change(shop).filter(F.col("diff_from_prev_year").isNotNull()))


def _customer_years(shop):
    return shop.payments.groupBy("customer_id", F.year("payment_date").alias("y")).agg(
        F.sum("amount").alias("spent"), F.count("payment_date").alias("payments")
    )


@query("q40", """
WITH recurring AS (SELECT customer_id FROM payment GROUP BY ALL HAVING count(payment_date) > 1),
y AS (SELECT strftime(payment_date, '%Y') AS payment_year, sum(amount) AS spent
      FROM payment SEMI JOIN recurring USING (customer_id) GROUP BY ALL)
SELECT payment_year, (spent - lag(spent) OVER (ORDER BY payment_year))::DOUBLE AS change FROM y""")
def spend_change_of_recurring_customers(shop):
    # The payment count comes from the same (customer, year) rows, so the facts are read once.
    payments = F.sum("payments").over(Window.partitionBy("customer_id"))
    years = (
        _customer_years(shop)
        .withColumn("all_payments", payments)
        .filter(F.col("all_payments") > 1)
        .groupBy("y")
        .agg(F.sum("spent").alias("spent"))
    )
    return period.with_previous(years, [], ["y"], "spent", "prev").select(
        F.col("y").cast("string").alias("payment_year"),
        (F.col("spent") - F.col("prev")).cast("double").alias("change"),
    )


@query("q40_intent", """
WITH y AS (SELECT customer_id, year(payment_date) AS payment_year, sum(amount) AS spent
           FROM payment GROUP BY ALL)
SELECT cur.customer_id, cur.payment_year, cur.spent::DOUBLE AS amount_spent,
       (cur.spent - prev.spent)::DOUBLE AS change
FROM y cur LEFT JOIN y prev ON cur.customer_id = prev.customer_id AND cur.payment_year = prev.payment_year + 1
WHERE cur.customer_id IN (SELECT customer_id FROM y GROUP BY ALL HAVING count(*) > 1)""")
def spend_change_per_customer(shop):
    years = F.count("*").over(Window.partitionBy("customer_id"))
    return (
        _customer_years(shop)
        .withColumn("years", years)
        .filter(F.col("years") > 1)
        .withColumn("prev", period.value_at(["customer_id"], "y", "spent", -1))
        .select(
            "customer_id",
            F.col("y").cast("long").alias("payment_year"),
            F.col("spent").cast("double").alias("amount_spent"),
            (F.col("spent") - F.col("prev")).cast("double").alias("change"),
        )
    )


@query("q68", """
SELECT (year(payment_date) // 10 * 10)::BIGINT AS payment_year, category_id, sum(amount)::DOUBLE AS revenue
FROM payment JOIN film_cat USING (film_id) GROUP BY ALL""")
def revenue_per_payment_decade(shop):
    return _revenue_per_decade(shop, F.year("payment_date"), "payment_year")


@query("q68_intent", """
SELECT (release_year // 10 * 10)::BIGINT AS release_decade, category_id, sum(amount)::DOUBLE AS revenue
FROM payment JOIN film USING (film_id) JOIN film_cat USING (film_id) GROUP BY ALL""")
def revenue_per_release_decade(shop):
    return _revenue_per_decade(shop, F.col("release_year"), "release_decade")


def _revenue_per_decade(shop, year, name):
    return (
        shop.film_payments.join(shop.films_by_category, "film_id")
        .groupBy(d.decade(year).alias(name), "category_id")
        .agg(F.sum("amount").cast("double").alias("revenue"))
    )


@query("q115", """
WITH m AS (SELECT category_id, strftime(payment_date, '%Y-%m') AS payment_month, sum(amount) AS revenue
           FROM payment JOIN film_cat USING (film_id) GROUP BY ALL),
r AS (SELECT *,
        row_number() OVER (PARTITION BY category_id ORDER BY revenue DESC, payment_month) AS higheset_rank,
        row_number() OVER (PARTITION BY category_id ORDER BY revenue, payment_month) AS lowest_rank
      FROM m)
SELECT category_id, payment_month, revenue::DOUBLE AS rental_revenue, higheset_rank, lowest_rank
FROM r WHERE higheset_rank = 1 OR lowest_rank = 1""")
def best_and_worst_month_per_category(shop):
    months = (
        shop.film_payments.join(shop.film_category, "film_id")
        .groupBy("category_id", d.month_start("payment_date").alias("m"))
        .agg(F.sum("amount").alias("revenue"))
    )
    by = ["category_id"]
    return (
        months.withColumn("higheset_rank", ranking.small_rank(by, [F.col("revenue").desc(), F.col("m")], "row"))
        .withColumn("lowest_rank", ranking.small_rank(by, [F.col("revenue").asc(), F.col("m")], "row"))
        .filter((F.col("higheset_rank") == 1) | (F.col("lowest_rank") == 1))
        .select(
            "category_id",
            d.year_month("m").alias("payment_month"),
            F.col("revenue").cast("double").alias("rental_revenue"),
            "higheset_rank",
            "lowest_rank",
        )
        .orderBy("category_id")
    )


@query("q73", """
WITH m AS (SELECT store_id, strftime(payment_date, '%Y-%m') AS payment_month, sum(amount) AS revenue
           FROM payment GROUP BY ALL)
SELECT store_id, payment_month, revenue::DOUBLE AS revenue,
       (lag(revenue) OVER w)::DOUBLE AS prev_month_revenue, (lead(revenue) OVER w)::DOUBLE AS next_month_revenue
FROM m WINDOW w AS (PARTITION BY store_id ORDER BY payment_month)""")
def revenue_trend_per_store(shop):
    w = period.series(["store_id"], "month")
    return store_months(shop).select(
        "store_id",
        d.year_month("month").alias("payment_month"),
        F.col("revenue").cast("double").alias("revenue"),
        F.lag("revenue").over(w).cast("double").alias("prev_month_revenue"),
        F.lead("revenue").over(w).cast("double").alias("next_month_revenue"),
    )


@query("q103", """
WITH q AS (SELECT film_id, year(payment_date) * 4 + quarter(payment_date) - 1 AS i, sum(amount) AS revenue
           FROM payment WHERE film_id IS NOT NULL GROUP BY ALL)
SELECT cur.film_id, (cur.i // 4)::BIGINT AS year, (cur.i % 4 + 1)::BIGINT AS quarter,
       cur.revenue::DOUBLE AS revenue, prev.revenue::DOUBLE AS prev_quarter_revenue,
       (cur.revenue - prev.revenue)::DOUBLE AS revenue_change
FROM q cur LEFT JOIN q prev ON cur.film_id = prev.film_id AND cur.i = prev.i + 1""")
def revenue_change_per_film_quarter(shop):
    quarters = shop.film_payments.groupBy("film_id", d.quarter_index("payment_date").alias("q")).agg(
        F.sum("amount").alias("revenue")
    )
    return quarters.withColumn("prev", period.value_at(["film_id"], "q", "revenue", -1)).select(
        "film_id",
        F.floor(F.col("q") / 4).alias("year"),
        (F.col("q") % 4 + 1).alias("quarter"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("prev").cast("double").alias("prev_quarter_revenue"),
        (F.col("revenue") - F.col("prev")).cast("double").alias("revenue_change"),
    )


@query("q107", """
WITH m AS (SELECT staff_id, strftime(rental_date, '%Y-%m') AS rental_year_month, count(*) AS rental_count
           FROM rental GROUP BY ALL)
SELECT *, lag(rental_count) OVER w AS prev_month_count, rental_count - lag(rental_count) OVER w AS change
FROM m WINDOW w AS (PARTITION BY staff_id ORDER BY rental_year_month)""")
def rentals_change_per_staff_month(shop):
    months = shop.staffed_rentals.groupBy("staff_id", d.month_start("rental_date").alias("m")).agg(
        F.count("*").alias("rental_count")
    )
    return period.with_previous(months, ["staff_id"], ["m"], "rental_count", "prev_month_count").select(
        "staff_id",
        d.year_month("m").alias("rental_year_month"),
        "rental_count",
        "prev_month_count",
        (F.col("rental_count") - F.col("prev_month_count")).alias("change"),
    )


@query("q111", """
WITH m AS (SELECT date_trunc('month', payment_date) AS m, sum(amount) AS revenue FROM payment GROUP BY ALL)
SELECT strftime(cur.m, '%Y-%m') AS payment_month, cur.revenue::DOUBLE AS revenue,
       prev.revenue::DOUBLE AS same_month_last_year, (cur.revenue - prev.revenue)::DOUBLE AS change,
       (cur.revenue - prev.revenue)::DOUBLE / prev.revenue::DOUBLE * 100 AS pct_change
FROM m cur LEFT JOIN m prev ON cur.m = prev.m + INTERVAL 12 MONTH""")
def revenue_against_last_year(shop):
    months = shop.takings.groupBy(d.month_start("payment_date").alias("m")).agg(F.sum("amount").alias("revenue"))
    return (
        months.withColumn("i", d.month_index("m"))
        .withColumn("prev", period.value_at([], "i", "revenue", -12))
        .select(
            d.year_month("m").alias("payment_month"),
            F.col("revenue").cast("double").alias("revenue"),
            F.col("prev").cast("double").alias("same_month_last_year"),
            (F.col("revenue") - F.col("prev")).cast("double").alias("change"),
            d.percent_change(F.col("revenue"), F.col("prev")).alias("pct_change"),
        )
    )


@query("q112", """
WITH m AS (SELECT strftime(rental_date, '%Y-%m') AS rental_month, count(*) AS rental_count FROM rental GROUP BY ALL),
l AS (SELECT *, lag(rental_count) OVER (ORDER BY rental_month) AS prev_month_count FROM m)
SELECT *, round((rental_count - prev_month_count) * 100.0::DOUBLE / prev_month_count, 2) AS pct_change
FROM l WHERE rental_count < prev_month_count""")
def months_with_decline(shop):
    months = _monthly_rentals(shop.rentals).withColumnRenamed("total_rents", "rental_count")
    change = d.ratio((F.col("rental_count") - F.col("prev_month_count")) * F.lit(100.0), F.col("prev_month_count"))
    return (
        period.with_previous(months, [], ["m"], "rental_count", "prev_month_count")
        .filter(F.col("rental_count") < F.col("prev_month_count"))
        .select(
            d.year_month("m").alias("rental_month"),
            "rental_count",
            "prev_month_count",
            F.round(change, 2).alias("pct_change"),
        )
    )
