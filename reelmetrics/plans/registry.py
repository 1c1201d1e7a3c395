"""The catalogue: each entry pairs a Spark plan with the SQL that defines its answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reelmetrics.sources.domain import OrderShop, Shop

# The views of sources/domain.py over the order tables, restated in SQL.
VIEWS = """
store AS (SELECT r_regionkey::BIGINT AS store_id FROM region),
staff AS (
  SELECT n_nationkey::BIGINT AS staff_id, n_regionkey::BIGINT AS store_id,
         n_name AS first_name, r_name AS last_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (
  SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
         c_nationkey::BIGINT AS staff_id, n_regionkey::BIGINT AS store_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
film AS (
  SELECT p_partkey AS film_id, p_name AS title, p_size AS allowed_days, 1950 + p_size AS release_year FROM part),
film_cat AS (SELECT p_partkey AS film_id, p_type AS category_id FROM part),
film_actor AS (
  SELECT DISTINCT film_id, unnest(string_split(title, ' ')) AS actor FROM film),
rental AS (
  SELECT o_orderkey AS rental_id, o_custkey AS customer_id, o_orderdate AS rental_date,
         cust.staff_id, cust.store_id
  FROM orders JOIN cust ON o_custkey = customer_id),
shelf AS (
  SELECT s_suppkey AS copy_id, n_regionkey::BIGINT AS store_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
line AS (
  SELECT l_orderkey AS rental_id, l_partkey AS film_id, l_suppkey AS copy_id,
         l_extendedprice::DECIMAL(18,2) AS amount, l_shipdate AS payment_date,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS return_date, l_returnflag <> 'N' AS rented
  FROM lineitem),
rented AS (
  SELECT rental.*, film_id, copy_id, return_date, shelf.store_id AS shelf_id
  FROM line JOIN rental USING (rental_id) JOIN shelf USING (copy_id)),
rental_film AS (
  SELECT rental_date, film.film_id FROM rented LEFT JOIN film ON rented.film_id = film.film_id),
stock AS (
  SELECT film_id, copy_id, store_id, rental_id, return_date, rented FROM line JOIN shelf USING (copy_id)),
timed AS (SELECT ts, staff_id FROM events JOIN cust ON user_id = customer_id),
payment AS (
  SELECT rental.*, amount, payment_date, film_id, customer_id AS renter_id, store_id AS renting_store_id
  FROM line JOIN rental USING (rental_id)),
charge AS (
  SELECT o_orderkey AS payment_id, o_orderkey AS rental_id, o_custkey AS customer_id,
         o_totalprice::DECIMAL(18,2) AS amount, o_orderdate AS rental_date, o_custkey AS renter_id
  FROM orders)
"""


@dataclass(frozen=True)
class Query:
    build: Callable[[Shop], DataFrame]
    oracle: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register a plan written against a Shop. ``oracle`` is SQL over VIEWS and may open with WITH."""

    def register(build):
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Query(build, oracle)
        return build

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = CATALOGUE[name].build
    return lambda spark, sf_dir: build(OrderShop(spark, sf_dir))


def oracle_text(name: str, views: str = VIEWS) -> str | None:
    sql = CATALOGUE[name].oracle
    if sql is None:
        return None
    sql = sql.strip()
    opening = f"WITH {views.strip()}"
    return f"{opening},\n{sql[5:]}" if sql.startswith("WITH ") else f"{opening}\n{sql}"
