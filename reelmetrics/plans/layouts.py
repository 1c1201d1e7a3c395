"""Queries over laid-out tables; each answer equals the query over the plain table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmetrics.functions import dates as d
from reelmetrics.operators.ranking import top_by_value
from reelmetrics.plans.registry import query
from reelmetrics.sources import layout


def _month_partitions(shop, name, df, timestamp, identifier):
    """The rows in month partitions, and the days that have rows with their month."""
    path = layout.written_once(df, name, lambda p: layout.partition_by_month(df, timestamp, identifier, p))
    schema = df.withColumn("ym", F.lit(0)).schema
    return shop.spark.read.schema(schema).parquet(f"{path}/rows"), shop.spark.read.schema("ym int, day date").parquet(f"{path}/days")


def _months(days, start, end):
    """The months of the days from ``start`` to before ``end``."""
    day = F.col("day")
    return days.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))).select("ym")


@query("q82", """
SELECT rental_date, count(*) AS rental_count FROM rental
WHERE rental_date >= TIMESTAMP '2000-03-15' AND rental_date < TIMESTAMP '2000-06-15' GROUP BY rental_date""")
def rentals_in_date_range(shop, start="2000-03-15", end="2000-06-15"):
    rentals, days = _month_partitions(
        shop, "rentals_by_month", shop.rentals, "rental_date", "rental_id"
    )
    date = F.col("rental_date")
    # The scan learns the months from the calendar at run time, and opens no other partitions.
    return (
        rentals.join(_months(days, start, end), "ym", "left_semi")
        .filter((date >= F.lit(start).cast("timestamp_ntz")) & (date < F.lit(end).cast("timestamp_ntz")))
        .groupBy("rental_date")
        .agg(F.count("*").alias("rental_count"))
    )


@query("q83", "SELECT customer_id, first_name, last_name FROM cust WHERE last_name = 'BUILDING'")
def customers_by_last_name(shop, last_name="BUILDING"):
    customers = shop.customers
    path = layout.written_once(
        customers, "customers_by_name", lambda p: layout.sort_files(customers, "last_name", "customer_id", p)
    )
    return shop.spark.read.schema(customers.schema).parquet(path).filter(F.col("last_name") == last_name)


@query("q83_unsorted", "SELECT customer_id, first_name, last_name FROM cust WHERE last_name = 'BUILDING'")
def customers_by_last_name_unsorted(shop, last_name="BUILDING", distinct=100_000):
    """The same over files in any order, by Bloom filters."""
    customers = shop.customers
    path = layout.written_once(
        customers, "customers_with_bloom", lambda p: layout.bloom_files(customers, "last_name", distinct, p)
    )
    return shop.spark.read.schema(customers.schema).parquet(path).filter(F.col("last_name") == last_name)


def bucketed_tables(shop):
    """Rentals, row by row, and stock, bucketed on the copy."""
    keys = ["film_id", "copy_id"]
    buckets = int(shop.spark.conf.get("spark.sql.shuffle.partitions"))
    frames = {
        "bucketed_rentals": shop.rented_copies.select(*keys, "rental_id"),
        "bucketed_stock": shop.shelf_stock.select(*keys, "store_id").distinct(),
    }

    def table(name, df):
        # The folder name is unique, so the table name is too, also in a shared catalog.
        def name_of(path):
            return "_".join(reversed(path.split("/")[-2:]))

        path = layout.written_once(df, name, lambda p: layout.bucket(df, keys, buckets, name_of(p), p))
        return shop.spark.table(name_of(path))

    return [table(name, df) for name, df in frames.items()]


@query("q84", """
SELECT film_id, count(*) AS rental_count, rank() OVER (ORDER BY count(*) DESC) AS rank
FROM rented GROUP BY film_id QUALIFY rank <= 10""")
def most_rented_films_bucketed(shop, n=10):
    rentals, stock = bucketed_tables(shop)
    counts = (
        rentals.join(stock, ["film_id", "copy_id"])
        .groupBy("film_id")
        .agg(F.count("*").alias("rental_count"))
    )
    return top_by_value(counts, [], "rental_count", n).select("film_id", "rental_count", "rank")


@query("q85", """
SELECT strftime(payment_date, '%Y-%m') AS payment_month, sum(amount)::DOUBLE AS revenue FROM payment
WHERE payment_date >= TIMESTAMP '2000-01-01' AND payment_date < TIMESTAMP '2001-01-01' GROUP BY ALL""")
def monthly_revenue_from_partitions(shop, year=None):
    year = year or shop.year
    payments = shop.takings.select("rental_id", "payment_date", "amount")
    stored, days = _month_partitions(shop, "payments_by_month", payments, "payment_date", "rental_id")
    return (
        stored.join(_months(days, f"{year}-01-01", f"{year + 1}-01-01"), "ym", "left_semi")
        .groupBy("ym")
        .agg(F.sum("amount").cast("double").alias("revenue"))
        .select(
            d.year_month(F.make_date(F.floor(F.col("ym") / 100).cast("int"), F.col("ym") % 100, F.lit(1))).alias(
                "payment_month"
            ),
            "revenue",
        )
    )
