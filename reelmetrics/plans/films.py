"""Stock, lateness, actors and film growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators.pairs import frequent_pairs
from reelmetrics.operators.ranking import ranked, small_rank, top, top_by_value
from reelmetrics.plans.rankings import film_counts, with_titles
from reelmetrics.plans.registry import query


@query("q51", """
SELECT store_id, film_id FROM stock GROUP BY ALL HAVING NOT bool_or(rented)""")
def stocked_but_never_rented(shop):
    # The stock view marks each copy's rentals, so one aggregate replaces the anti-join.
    return (
        shop.shelf_stock.groupBy("store_id", "film_id")
        .agg(F.max(F.col("rented").cast("int")).alias("rented"))
        .filter(F.col("rented") == 0)
        .select("store_id", "film_id")
    )


def _demand(rows, *keys):
    """Rentals and distinct copies per key; counting per copy first keeps every shuffle partial."""
    return (
        rows.filter(F.col("film_id").isNotNull())
        .groupBy(*keys, "copy_id")
        .agg(F.count("rental_id").alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("rental_count"), F.count("*").alias("copies"))
        .withColumn("rentals_per_copy", d.ratio(F.col("rental_count"), F.col("copies")))
    )


@query("q52", """
SELECT store_id, film_id, title, count(rental_id) AS rental_count, count(DISTINCT copy_id) AS copies,
       count(rental_id)::DOUBLE / count(DISTINCT copy_id) AS rentals_per_copy,
       rank() OVER (PARTITION BY store_id ORDER BY count(rental_id)::DOUBLE / count(DISTINCT copy_id) DESC) AS rank
FROM stock JOIN film USING (film_id) GROUP BY store_id, film_id, title QUALIFY rank <= 5""")
def scarce_films_per_store(shop, n=5):
    demand = _demand(shop.shelf_stock, "store_id", "film_id")
    best = top_by_value(demand, ["store_id"], "rentals_per_copy", n)
    return with_titles(best, shop).select(
        "store_id", "film_id", "title", "rental_count", "copies", "rentals_per_copy", "rank"
    )


@query("q101", """
SELECT film_id, title, count(rental_id) AS rental_count, count(DISTINCT copy_id) AS copies,
       count(rental_id)::DOUBLE / count(DISTINCT copy_id) AS rentals_per_copy,
       rank() OVER (ORDER BY count(rental_id)::DOUBLE / count(DISTINCT copy_id) DESC) AS rank
FROM stock JOIN film USING (film_id) GROUP BY film_id, title QUALIFY rank <= 10""")
def scarce_films(shop, n=10):
    best = top_by_value(_demand(shop.stock, "film_id"), [], "rentals_per_copy", n)
    return with_titles(best, shop).select("film_id", "title", "rental_count", "copies", "rentals_per_copy", "rank")


@query("q53", """
WITH c AS (SELECT film_id, store_id, copy_id, bool_or(rental_id IS NOT NULL AND return_date IS NULL) AS is_out
           FROM stock GROUP BY ALL),
s AS (SELECT film_id, store_id, count(*) AS copies, count(*) FILTER (NOT is_out) AS available_copies
      FROM c GROUP BY ALL)
SELECT *, (rank() OVER (PARTITION BY film_id ORDER BY copies DESC) = 1)::BIGINT AS has_most_copies FROM s""")
def availability_per_film_and_store(shop):
    is_open = F.col("rental_id").isNotNull() & F.col("return_date").isNull()
    per_copy = shop.shelf_stock.groupBy("film_id", "store_id", "copy_id").agg(
        F.max(is_open.cast("int")).alias("is_out")
    )
    stock = per_copy.groupBy("film_id", "store_id").agg(
        F.count("*").alias("copies"), F.count_if(F.col("is_out") == 0).alias("available_copies")
    )
    most = small_rank(["film_id"], [F.col("copies").desc()]) == 1
    return stock.withColumn("has_most_copies", most.cast("long"))


def is_late():
    """Returned after the allowed days; an open rental is not counted."""
    allowed = F.col("allowed_days").cast("long") * F.lit(d.MICROS_PER_DAY)
    return d.micros_between("return_date", "rental_date") > allowed


def _with_allowance(rows, shop):
    returned = rows.filter(F.col("return_date").isNotNull())
    return returned.join(shop.films.select("film_id", "allowed_days"), "film_id")


@query("q54", """
WITH l AS (
  SELECT film_id, title, category_id, count(*) AS late_returns, rank() OVER (ORDER BY count(*) DESC) AS rank
  FROM rented JOIN film USING (film_id) JOIN film_cat USING (film_id)
  WHERE epoch_us(return_date) - epoch_us(rental_date) > allowed_days * 86400000000
  GROUP BY film_id, title, category_id QUALIFY rank <= 10)
SELECT film_id, title, category_id, late_returns, rank, string_agg(actor, ', ' ORDER BY actor) AS actors
FROM l JOIN film_actor USING (film_id) GROUP BY ALL""")
def films_most_often_late(shop, n=10):
    late = _with_allowance(shop.rented, shop).filter(is_late())
    counts = late.groupBy("film_id").agg(F.count("*").alias("late_returns"))
    best = top_by_value(counts, [], "late_returns", n).join(shop.films_by_category, "film_id")
    columns = ["film_id", "title", "category_id", "late_returns", "rank"]
    # The cast of one film is a short list, bounded by the film and not by the rentals.
    cast = F.concat_ws(", ", F.sort_array(F.collect_set("actor")))
    return best.join(shop.film_actor, "film_id").groupBy(*columns).agg(cast.alias("actors"))


@query("q55", """
SELECT category_id, count(*) AS rental_count, count(return_date) AS return_count,
       count(return_date)::DOUBLE / count(*) AS return_rate
FROM rented JOIN film_cat USING (film_id) GROUP BY category_id
QUALIFY rank() OVER (ORDER BY count(return_date)::DOUBLE / count(*)) = 1""")
def category_with_lowest_return_rate(shop):
    rates = (
        shop.rented_copies.join(shop.film_category, "film_id")
        .groupBy("category_id")
        .agg(F.count("*").alias("rental_count"), F.count("return_date").alias("return_count"))
        .withColumn("return_rate", d.ratio(F.col("return_count"), F.col("rental_count")))
    )
    return top(rates, [], [F.col("return_rate").asc()]).drop("rank")


# Rentals are summed per film before the many-to-many join with actors, so the facts never fan out.


POPULAR = """
WITH f AS (SELECT film_id, sum(amount) AS revenue FROM payment GROUP BY film_id HAVING count(*) > {})
SELECT actor, sum(revenue)::DOUBLE AS revenue, rank() OVER (ORDER BY sum(revenue) DESC) AS rank
FROM f JOIN film_actor USING (film_id) GROUP BY actor"""


@query("q42_over_30", POPULAR.format(30))
def actors_by_revenue_of_films_over_30(shop):
    """The question with a limit that the order tables reach."""
    return actors_by_revenue_of_popular_films(shop, 30)


@query("q42", POPULAR.format(50))
def actors_by_revenue_of_popular_films(shop, more_than=50):
    films = shop.film_payments.groupBy("film_id").agg(F.sum("amount").alias("revenue"), F.count("*").alias("n"))
    return _actors_by_revenue(shop, films.filter(F.col("n") > more_than))


@query("q57", """
SELECT actor, sum(amount)::DOUBLE AS revenue, rank() OVER (ORDER BY sum(amount) DESC) AS rank
FROM payment JOIN film_actor USING (film_id) GROUP BY actor""")
def actors_by_revenue(shop):
    return _actors_by_revenue(shop, shop.film_payments.groupBy("film_id").agg(F.sum("amount").alias("revenue")))


def _actors_by_revenue(shop, films):
    actors = films.join(shop.film_actor, "film_id").groupBy("actor").agg(F.sum("revenue").alias("revenue"))
    out = ranked(actors, [], "revenue", "rank")
    return out.select("actor", F.col("revenue").cast("double").alias("revenue"), "rank")


@query("q56", """
SELECT actor, film_id, title, count(*) AS rental_count,
       rank() OVER (PARTITION BY actor ORDER BY count(*) DESC) AS rank
FROM rented JOIN film USING (film_id) JOIN film_actor USING (film_id)
GROUP BY actor, film_id, title QUALIFY rank <= 5""")
def top_films_per_actor(shop, n=5):
    counts = film_counts(shop.rented_copies).join(shop.film_actor, "film_id")
    best = top_by_value(counts, ["actor"], "rental_count", n)
    return with_titles(best, shop).select("actor", "film_id", "title", "rental_count", "rank")


@query("q58", """
SELECT actor, count(DISTINCT film_id) AS rented_films FROM rented JOIN film_actor USING (film_id) GROUP BY actor
QUALIFY rank() OVER (ORDER BY count(DISTINCT film_id) DESC) = 1""")
def actor_in_most_rented_films(shop):
    seen = film_counts(shop.rented_copies).select("film_id")
    films = shop.film_actor.join(seen, "film_id", "left_semi").groupBy("actor").agg(F.count("*").alias("rented_films"))
    return top_by_value(films, [], "rented_films").drop("rank")


@query("q59", """
WITH f AS (SELECT film_id, count(*) AS n FROM rented
           WHERE rental_date >= TIMESTAMP '2001-08-01' - INTERVAL 12 MONTH AND rental_date <= TIMESTAMP '2001-08-01'
           GROUP BY film_id),
a AS (SELECT actor, coalesce(sum(n), 0)::BIGINT AS rental_count
      FROM film_actor LEFT JOIN f USING (film_id) GROUP BY actor),
least_rented AS (SELECT * FROM a WHERE rental_count = (SELECT min(rental_count) FROM a))
SELECT actor, rental_count, film_id, title
FROM least_rented JOIN film_actor USING (actor) JOIN film USING (film_id)""")
def films_of_least_rented_actors(shop, months=12):
    date = F.col("rental_date")
    recent = film_counts(shop.rented.filter((date >= shop.months_ago(months)) & (date <= shop.today)), name="n")
    actors = (
        shop.film_actor.join(recent, "film_id", "left")
        .groupBy("actor")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("rental_count"))
    )
    least = top_by_value(actors, [], "rental_count", descending=False).drop("rank")
    # One row per film instead of a list: an actor's list has no size bound.
    return with_titles(least.join(shop.film_actor, "actor"), shop).select("actor", "rental_count", "film_id", "title")


@query("q60", """
SELECT actor, count(DISTINCT category_id) AS categories FROM film_actor JOIN film_cat USING (film_id) GROUP BY actor
QUALIFY rank() OVER (ORDER BY count(DISTINCT category_id) DESC) = 1""")
def actors_across_most_categories(shop):
    pairs = shop.film_actor.join(shop.film_category, "film_id").select("actor", "category_id").distinct()
    counts = pairs.groupBy("actor").agg(F.count("*").alias("categories"))
    return top_by_value(counts, [], "categories").drop("rank")


@query("q99", """
WITH b AS (SELECT DISTINCT customer_id, film_id FROM rented)
SELECT x.film_id AS film_a, y.film_id AS film_b, count(*) AS customers
FROM b x JOIN b y ON x.customer_id = y.customer_id AND x.film_id < y.film_id
GROUP BY ALL HAVING count(*) >= 5""")
def films_rented_together(shop, min_support=5):
    # A customer's row makes a pair with every other film of theirs, so pairs get more tasks than rows.
    pairs = frequent_pairs(shop.rented, "customer_id", "film_id", min_support, slices=shop.slices(parts=4))
    return pairs.select(
        F.col("item_a").alias("film_a"), F.col("item_b").alias("film_b"), F.col("support").alias("customers")
    )


@query("q104", """
SELECT film_id, year(rental_date) AS rental_year FROM rented
GROUP BY ALL HAVING count(DISTINCT month(rental_date)) = 12""")
def films_rented_every_month(shop):
    return rented_every_month(shop.rented, "film_id")


@query("q104_category", """
SELECT category_id, year(rental_date) AS rental_year FROM rented JOIN film_cat USING (film_id)
GROUP BY ALL HAVING count(DISTINCT month(rental_date)) = 12""")
def categories_rented_every_month(shop):
    return rented_every_month(shop.rented.join(shop.film_category, "film_id"), "category_id")


def rented_every_month(rows, entity):
    """A bit for each month of a year, joined by OR: one shuffle of a number for each entity and year."""
    bit = F.call_function("shiftleft", F.lit(1), F.month("rental_date") - 1)
    return (
        rows.groupBy(entity, d.year_number("rental_date").alias("rental_year"))
        .agg(F.bit_or(bit).alias("months"))
        .filter(F.col("months") == 2**12 - 1)
        .drop("months")
    )


@query("q113", """
WITH y AS (SELECT film_id, title, count(*) FILTER (year(rental_date) = 1999) AS prev_count,
                  count(*) FILTER (year(rental_date) = 2000) AS rental_count
           FROM rented JOIN film USING (film_id) GROUP BY ALL)
SELECT film_id, title, prev_count, rental_count, rental_count::DOUBLE / prev_count AS growth
FROM y WHERE prev_count > 0 AND rental_count >= 2 * prev_count""")
def films_with_major_growth(shop, year=None, factor=2):
    """Growth in the last full year before the reporting date, if no other year is given."""
    year = year or int(shop.as_of[:4]) - 1
    bounds = [F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year - 1, year, year + 1)]
    date = F.col("rental_date")
    years = (
        shop.rented.filter((date >= bounds[0]) & (date < bounds[2]))
        .groupBy("film_id")
        .agg(F.count_if(date < bounds[1]).alias("prev_count"), F.count_if(date >= bounds[1]).alias("rental_count"))
        .filter((F.col("prev_count") > 0) & (F.col("rental_count") >= factor * F.col("prev_count")))
        .withColumn("growth", d.ratio(F.col("rental_count"), F.col("prev_count")))
    )
    return with_titles(years, shop).select("film_id", "title", "prev_count", "rental_count", "growth")
