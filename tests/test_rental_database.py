"""The whole catalogue over a rental shop's own tables.

Here payments, rentals and shelves belong to different stores, rentals have none or several
payments, payments may lack a rental, prices repeat, copies stand unrented, and a film may have
two categories: everything the order tables cannot show.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

import check
from reelmetrics.plans import catalogue
from reelmetrics.sources import tables
from reelmetrics.sources.domain import RentalDatabase

VIEWS = """
own_staff AS (SELECT * FROM staff_table SEMI JOIN store_table USING (store_id)),
store AS (SELECT store_id FROM store_table),
staff AS (SELECT staff_id, store_id, first_name, last_name FROM own_staff),
cust AS (SELECT * FROM customer_table),
film AS (SELECT * FROM film_table),
film_cat AS (SELECT * FROM film_category_table),
film_actor AS (
  SELECT film_id, name || ' (' || actor_id || ')' AS actor FROM film_actor_table JOIN actor_table USING (actor_id)),
rental AS (
  SELECT rental_id, customer_id, rental_date, staff_id, store_id FROM rental_table JOIN own_staff USING (staff_id)),
rented AS (
  SELECT r.rental_id, r.customer_id, r.rental_date, r.return_date, r.staff_id, s.store_id, i.film_id,
         i.inventory_id AS copy_id, i.store_id AS shelf_id
  FROM rental_table r JOIN own_staff s USING (staff_id) JOIN inventory_table i USING (inventory_id)),
rental_film AS (SELECT rental_date, film_id FROM rental_table LEFT JOIN inventory_table USING (inventory_id)),
stock AS (
  SELECT film_id, inventory_id AS copy_id, store_id, rental_id, return_date, rental_id IS NOT NULL AS rented
  FROM inventory_table LEFT JOIN rental_table USING (inventory_id)),
timed AS (SELECT rental_date AS ts, staff_id FROM rental_table),
payment AS (
  SELECT p.payment_id, p.rental_id, p.customer_id, p.staff_id, s.store_id, p.amount, p.payment_date,
         r.rental_date, r.customer_id AS renter_id, r.store_id AS renting_store_id, r.film_id
  FROM payment_table p JOIN own_staff s USING (staff_id) LEFT JOIN rented r ON p.rental_id = r.rental_id),
charge AS (SELECT payment_id, rental_id, customer_id, amount, rental_date, renter_id FROM payment)
"""


# Nobody rented last names BUILDING here.
EMPTY = {"q83", "q83_unsorted", "q50"}


def build(rng):
    stores, staff, films, customers = range(1, 4), range(1, 8), range(1, 31), range(1, 61)
    out = {
        "store": [(s,) for s in stores],
        "staff": [(i, i % 3 + 1, f"First{i}", None if i == 7 else f"Last{i}") for i in staff],
        "customer": [(c, f"First{c}", f"Last{c % 9}", rng.choice(stores)) for c in customers],
        "film": [(f, f"Film {f}", rng.randint(3, 7), 1950 + f * 2) for f in films],
        "category": [(c, f"Category {c}") for c in range(1, 5)],
        "film_category": [(f, f % 4 + 1) for f in films] + [(1, 1)],
        "actor": [(a, f"Actor {a % 7}") for a in range(1, 9)],
        "film_actor": [(a, f) for f in films for a in rng.sample(range(1, 9), 2)],
    }
    inventory = [(i, rng.choice(films), rng.choice(stores)) for i in range(1, 121)]
    home = {c: row[3] for c, row in zip(customers, out["customer"])}
    start = datetime(1999, 1, 1)
    rentals, payments = [], []
    for n in range(1, 1601):
        customer = 1 if rng.random() < 0.33 else rng.choice(customers)
        copy = rng.randint(1, 100)  # copies 101 to 120 are never rented
        while customer > 55 and inventory[copy - 1][2] == home[customer]:
            copy = rng.randint(1, 100)  # these customers avoid their own store
        film = inventory[copy - 1][1]
        date = start + timedelta(days=rng.randint(0, 940), minutes=rng.choice([0, 0, 600, 605, 1111]))
        back = None if rng.random() < 0.1 else date + timedelta(hours=rng.randint(2, 240))
        handler = rng.choice(staff)
        rentals.append((n, date, copy, customer, handler, back))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            amount = Decimal(rng.choice(["0.99", "2.99", "4.99"]))
            taker = rng.choice(staff)
            paid = date + timedelta(days=rng.randint(0, 40))
            payer = customer if film % 5 else rng.choice(customers)
            payments.append((len(payments) + 1, None if rng.random() < 0.02 else n, payer, taker, amount, paid))
    return {**out, "inventory": inventory, "rental": rentals, "payment": payments}


class Database(RentalDatabase):
    """The terms that the shared SQL is written for."""

    year, before, last_day = 2000, "2001-01-01", "2001-08-01"


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rentals")
    for name, rows in build(random.Random(11)).items():
        df = spark.createDataFrame(rows, tables.RENTAL_SCHEMAS[name])
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def duck(database):
    con = check.oracle("/root/testdata/sf0.001")
    for name in tables.RENTAL_SCHEMAS:
        con.execute(f"CREATE VIEW {name}_table AS SELECT * FROM '{database}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.CATALOGUE))
def test_same_as_sql(spark, duck, database, name):
    df = catalogue.CATALOGUE[name].build(Database(spark, database))
    problem, count = check.compare(df, duck, catalogue.oracle_text(name, VIEWS))
    assert problem is None
    assert count > 0 or name in EMPTY


def test_references(spark, database):
    found = tables.orphans(spark, database, tables.RENTAL_SCHEMAS, tables.RENTAL_REFERENCES).collect()
    assert {r.reference: r.orphans for r in found}["payment.rental_id"] == 0
    assert {r.orphans for r in found} == {0}
