"""Customer cohorts and the stores they use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators import cohort, period
from reelmetrics.operators.ranking import tiled, top
from reelmetrics.plans.registry import query
from reelmetrics.plans.running import store_months


@query("q8", """
SELECT customer_id, month(rental_date) AS rental_month, count(DISTINCT year(rental_date)) AS years
FROM rental GROUP BY ALL HAVING count(DISTINCT year(rental_date)) > 1""")
def same_month_in_several_years(shop):
    months = shop.rentals.select("customer_id", d.month_start("rental_date").alias("m")).distinct()
    return (
        months.groupBy("customer_id", d.month_number("m").alias("rental_month"))
        .agg(F.count("*").alias("years"))
        .filter(F.col("years") > 1)
    )


@query("q44", """
WITH c AS (
  SELECT customer_id,
    count(*) FILTER (rental_date >= TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH) AS last_6_months,
    count(*) FILTER (rental_date >= TIMESTAMP '2001-08-01' - INTERVAL 12 MONTH
                     AND rental_date < TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH) AS prev_6_months
  FROM rental GROUP BY customer_id)
SELECT * FROM c WHERE last_6_months > prev_6_months""")
def customers_renting_more(shop):
    half, year = shop.months_ago(6), shop.months_ago(12)
    date = F.col("rental_date")
    # A customer without a rental in the last year has 0 > 0 and drops out, so the scan can be cut.
    return (
        shop.rentals.filter(date >= year)
        .groupBy("customer_id")
        .agg(
            F.count_if(date >= half).alias("last_6_months"),
            F.count_if(date < half).alias("prev_6_months"),
        )
        .filter(F.col("last_6_months") > F.col("prev_6_months"))
        .orderBy("customer_id")
    )


@query("q92", """
WITH c AS (
  SELECT customer_id,
    coalesce(sum(amount) FILTER (payment_date >= TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH), 0) AS a,
    coalesce(sum(amount) FILTER (payment_date < TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH), 0) AS b
  FROM payment
  WHERE payment_date >= TIMESTAMP '2001-08-01' - INTERVAL 12 MONTH AND payment_date <= TIMESTAMP '2001-08-01'
  GROUP BY customer_id)
SELECT customer_id, a::DOUBLE AS last_6_months, b::DOUBLE AS prev_6_months FROM c WHERE a > b""")
def customers_spending_more(shop):
    half, year = shop.months_ago(6), shop.months_ago(12)
    date = F.col("payment_date")
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        shop.payments.filter((date >= year) & (date <= shop.today))
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(date >= half, F.col("amount")).otherwise(zero)).alias("a"),
            F.sum(F.when(date < half, F.col("amount")).otherwise(zero)).alias("b"),
        )
        .filter(F.col("a") > F.col("b"))
        .select(
            "customer_id",
            F.col("a").cast("double").alias("last_6_months"),
            F.col("b").cast("double").alias("prev_6_months"),
        )
    )


def _category_counts(shop, *extra):
    rows = shop.shelf_rented if extra else shop.rented
    return cohort.item_counts(rows.join(shop.film_category, "film_id"), [*extra, "customer_id"], "category_id")


@query("q41", """
SELECT customer_id FROM rented JOIN film_cat USING (film_id) GROUP BY customer_id
HAVING count(DISTINCT category_id) = (SELECT count(DISTINCT category_id) FROM film_cat)""")
def customers_of_every_category(shop):
    categories = shop.film_category.select("category_id").distinct()
    return cohort.covers_all(_category_counts(shop), ["customer_id"], categories).select("customer_id")


@query("q45", """
WITH c AS (SELECT shelf_id AS store_id, customer_id, count(*) AS n FROM rented GROUP BY ALL)
SELECT store_id, count(*) FILTER (n = 1) AS one_time_renters, count(*) AS renters,
       count(*) FILTER (n = 1)::DOUBLE / count(*) AS one_time_share
FROM c GROUP BY store_id
QUALIFY rank() OVER (ORDER BY count(*) FILTER (n = 1)::DOUBLE / count(*) DESC) = 1""")
def store_with_most_one_time_renters(shop):
    per_customer = shop.shelf_rented.groupBy("store_id", "customer_id").agg(F.count("*").alias("n"))
    once = F.col("n") == 1
    shares = per_customer.groupBy("store_id").agg(
        F.count_if(once).alias("one_time_renters"),
        F.count("*").alias("renters"),
        cohort.share(once).alias("one_time_share"),
    )
    return top(shares, [], [F.col("one_time_share").desc()]).drop("rank")


@query("q46", """
SELECT customer_id, count(*) AS total_rentals FROM rented GROUP BY customer_id
HAVING count(DISTINCT shelf_id) = (SELECT count(*) FROM store)""")
def customers_of_every_store(shop):
    counts = cohort.item_counts(shop.shelf_rented, ["customer_id"], "store_id")
    return cohort.covers_all(counts, ["customer_id"], shop.stores, total_rentals=F.sum("n"))


@query("q48", """
WITH c AS (SELECT customer_id, category_id, count(*) AS rental_count
           FROM rented JOIN film_cat USING (film_id) GROUP BY ALL)
SELECT * FROM c WHERE customer_id IN (SELECT customer_id FROM c GROUP BY ALL HAVING count(*) >= 3)""")
def rentals_per_category_of_varied_customers(shop, at_least=3):
    # One row per (customer, category), so the window holds no more rows than there are categories.
    categories = F.count("*").over(Window.partitionBy("customer_id"))
    return (
        _category_counts(shop)
        .withColumn("categories", categories)
        .filter(F.col("categories") >= at_least)
        .select("customer_id", "category_id", F.col("n").alias("rental_count"))
    )


@query("q49", """
SELECT DISTINCT customer_id FROM rented
WHERE NOT EXISTS (SELECT 1 FROM rented x JOIN cust USING (customer_id)
                  WHERE x.customer_id = rented.customer_id AND x.shelf_id = cust.store_id)""")
def never_at_signup_store(shop):
    visited = shop.shelf_rented.select("customer_id", "store_id").distinct()
    home = shop.signup_stores.select("customer_id", F.col("store_id").alias("home"))
    return (
        visited.join(home, "customer_id", "left")  # without a known signup store nobody is at home
        .groupBy("customer_id")
        .agg(F.max(F.coalesce(F.col("store_id") == F.col("home"), F.lit(False)).cast("int")).alias("at_home"))
        .filter(F.col("at_home") == 0)
        .select("customer_id")
    )


@query("q50", """
SELECT customer_id, min(shelf_id) AS store_id FROM rented
GROUP BY customer_id HAVING count(DISTINCT shelf_id) = 1""")
def customers_of_one_store(shop):
    return _of_one_store(shop.shelf_rented)


@query("q50_recent", """
SELECT customer_id, min(shelf_id) AS store_id FROM rented WHERE rental_date >= TIMESTAMP '2001-02-01'
GROUP BY customer_id HAVING count(DISTINCT shelf_id) = 1""")
def recent_customers_of_one_store(shop, months=6):
    """The question over the last months before the reporting date."""
    return _of_one_store(shop.shelf_rented.filter(F.col("rental_date") >= shop.months_ago(months)))


def _of_one_store(rented):
    ends = rented.groupBy("customer_id").agg(F.min("store_id").alias("store_id"), F.max("store_id").alias("other"))
    return ends.filter(F.col("store_id") == F.col("other")).drop("other")


@query("q64", """
WITH c AS (SELECT renting_store_id AS store_id, renter_id, count(DISTINCT rental_id) AS rentals,
                  sum(amount) AS revenue
           FROM payment WHERE renting_store_id IS NOT NULL GROUP BY ALL),
s AS (SELECT store_id, coalesce(sum(revenue) FILTER (rentals >= 2), 0)::DOUBLE / sum(revenue)::DOUBLE AS repeat_share
      FROM c GROUP BY store_id)
SELECT * FROM s QUALIFY rank() OVER (ORDER BY repeat_share DESC) = 1""")
def store_with_most_repeat_revenue(shop, repeat=2):
    paid = shop.takings.groupBy("rental_id").agg(F.sum("amount").alias("paid"))
    per_customer = (
        shop.staffed_rentals.join(paid, "rental_id")
        .groupBy("store_id", "customer_id")
        .agg(F.count("*").alias("rentals"), F.sum("paid").alias("revenue"))
    )
    shares = per_customer.groupBy("store_id").agg(
        cohort.share(F.col("rentals") >= repeat, F.col("revenue")).alias("repeat_share")
    )
    return top(shares, [], [F.col("repeat_share").desc()]).drop("rank")


@query("q66", """
SELECT customer_id, actor, count(*) AS rental_count FROM rented JOIN film_actor USING (film_id)
GROUP BY ALL HAVING count(*) > 1""")
def customers_returning_to_an_actor(shop):
    films = shop.rented.groupBy("customer_id", "film_id").agg(F.count("*").alias("n"))
    return (
        shop.meet(films, shop.film_actor, "film_id")
        .groupBy("customer_id", "actor")
        .agg(F.sum("n").alias("rental_count"))
        .filter(F.col("rental_count") > 1)
    )


@query("q67", """
WITH stocked AS (SELECT store_id, count(DISTINCT category_id) AS n FROM stock JOIN film_cat USING (film_id) GROUP BY ALL),
c AS (SELECT shelf_id, customer_id, count(DISTINCT category_id) AS n
      FROM rented JOIN film_cat USING (film_id) GROUP BY ALL)
SELECT c.shelf_id AS store_id, customer_id, c.n AS categories
FROM c JOIN stocked ON c.shelf_id = stocked.store_id AND c.n = stocked.n""")
def customers_of_every_category_of_a_store(shop):
    stocked = (
        shop.shelf_stock.join(shop.film_category, "film_id")
        .groupBy("store_id", "category_id")
        .agg(F.count("*").alias("copies"))
        .groupBy("store_id")
        .agg(F.count("*").alias("stocked"))
    )
    rented = _category_counts(shop, "store_id").groupBy("store_id", "customer_id").agg(F.count("*").alias("categories"))
    return (
        rented.join(stocked, "store_id")
        .filter(F.col("categories") == F.col("stocked"))
        .select("store_id", "customer_id", "categories")
    )


@query("q91", """
WITH s AS (SELECT customer_id, sum(amount) AS spend FROM payment GROUP BY customer_id)
SELECT customer_id, spend::DOUBLE AS total_spend,
       CASE ntile(3) OVER (ORDER BY spend DESC, customer_id)
         WHEN 1 THEN 'Premium' WHEN 2 THEN 'Regular' ELSE 'Low-spending' END AS segment
FROM s""")
def loyalty_segments(shop):
    spend = shop.payments.groupBy("customer_id").agg(F.sum("amount").alias("total_spend"))
    tile = F.col("tile")
    segment = F.when(tile == 1, "Premium").when(tile == 2, "Regular").otherwise("Low-spending")
    return tiled(spend, "total_spend", "customer_id", 3, "tile").select(
        "customer_id", F.col("total_spend").cast("double").alias("total_spend"), segment.alias("segment")
    )


def loyalty_segments_by_cutoffs(spend, premium, regular):
    """The same segments with fixed spend limits instead of thirds."""
    total = F.col("total_spend")
    segment = F.when(total >= premium, "Premium").when(total >= regular, "Regular").otherwise("Low-spending")
    return spend.withColumn("segment", segment)


@query("q70", """
WITH c AS (SELECT store_id, customer_id FROM rental GROUP BY ALL HAVING count(rental_id) >= 10)
SELECT store_id, count(*) AS cust_count FROM c GROUP BY store_id
QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1""")
def store_with_most_frequent_customers(shop, at_least=10):
    frequent = (
        shop.staffed_rentals.groupBy("store_id", "customer_id")
        .agg(F.count("rental_id").alias("n"))
        .filter(F.col("n") >= at_least)
        .groupBy("store_id")
        .agg(F.count("*").alias("cust_count"))
    )
    return top(frequent, [], [F.col("cust_count").desc()]).drop("rank")


@query("q105", """
WITH r AS (SELECT store_id, row_number() OVER (PARTITION BY customer_id ORDER BY rental_date, rental_id) AS rn
           FROM rental)
SELECT store_id, count(*) FILTER (rn = 1) AS first_rentals, count(*) AS rentals,
       count(*) FILTER (rn = 1)::DOUBLE / count(*) AS first_share
FROM r GROUP BY store_id QUALIFY rank() OVER (ORDER BY count(*) FILTER (rn = 1)::DOUBLE / count(*) DESC) = 1""")
def store_with_most_first_rentals(shop):
    # A customer's first rental is the earliest of their earliest rentals per store.
    # Two hash aggregates: the first rental of each moment, then the first moment.
    moments = shop.staffed_rentals.groupBy("customer_id", "store_id", "rental_date").agg(
        F.count("*").alias("n"), F.min("rental_id").alias("first_id")
    )
    visits = moments.groupBy("customer_id", "store_id").agg(
        F.sum("n").alias("n"), F.min("rental_date").alias("first"), F.min_by("first_id", "rental_date").alias("first_id")
    )
    is_first = F.row_number().over(Window.partitionBy("customer_id").orderBy("first", "first_id")) == 1
    shares = (
        visits.withColumn("is_first", is_first)
        .groupBy("store_id")
        .agg(F.count_if("is_first").alias("first_rentals"), F.sum("n").alias("rentals"))
        .withColumn("first_share", d.ratio(F.col("first_rentals"), F.col("rentals")))
    )
    return top(shares, [], [F.col("first_share").desc()]).drop("rank")


@query("q109", """
WITH m AS (SELECT store_id, year(payment_date) * 12 + month(payment_date) - 1 AS i, sum(amount) AS revenue
           FROM payment GROUP BY ALL),
g AS (SELECT a.store_id, a.i FROM m a JOIN m b ON a.store_id = b.store_id AND a.i = b.i + 1 AND a.revenue > b.revenue),
s AS (SELECT *, i - row_number() OVER (PARTITION BY store_id ORDER BY i) AS island FROM g)
SELECT store_id, strftime(make_date(min(i) // 12, min(i) % 12 + 1, 1), '%Y-%m') AS first_month,
       strftime(make_date(max(i) // 12, max(i) % 12 + 1, 1), '%Y-%m') AS last_month, count(*) AS months
FROM s GROUP BY store_id, island HAVING count(*) >= 3""")
def stores_with_sustained_growth(shop, months=3):
    growing = (
        store_months(shop)
        .withColumn("i", d.month_index("month"))
        .withColumn("prev", period.value_at(["store_id"], "i", "revenue", -1))
        .filter(F.col("revenue") > F.col("prev"))
    )
    return period.streaks(growing, ["store_id"], "i", months).select(
        "store_id",
        d.year_month(d.index_month("first_index")).alias("first_month"),
        d.year_month(d.index_month("last_index")).alias("last_month"),
        F.col("length").alias("months"),
    )
