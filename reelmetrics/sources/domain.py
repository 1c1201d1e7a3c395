"""The views every query is written against, and two sources for them.

:class:`RentalDatabase` reads a rental shop's own tables. :class:`OrderShop` reads order tables
(orders, lineitem, part, ...) as if they were a rental shop; the mapping is in FIXTURES.md.

Views are lazy and wide; Catalyst prunes unused columns down to the Parquet scan. A view joins no
more tables than its columns need, so a query without order dates never shuffles the orders.
Nothing is hinted here: small dimensions broadcast by their file size, large ones sort-merge, and
adaptive execution splits skewed partitions. Large facts meet other rows in slices whose number follows
the size of their files (:meth:`Shop.meet`): an aggregate that follows a join in the same stage holds
the groups of a whole task, and adaptive execution sizes tasks by shuffled bytes, not by those groups.

"Per store" has three meanings and they stay apart: ``store_payments`` (who took the money),
``staffed_rentals`` and ``rented_staff`` (who rented it out), ``shelf_*`` (where the copy stands).

Views a source provides, with their columns:

========================== =========================================================
stores                     store_id
staff                      staff_id, store_id, first_name, last_name
customers                  customer_id, first_name, last_name
signup_stores              customer_id, store_id
films                      film_id, title, allowed_days, release_year
film_category              film_id, category_id
films_by_category          films with category_id
film_actor                 film_id, actor
rentals                    rental_id, customer_id, rental_date
staffed_rentals            rentals with staff_id, store_id
rented_copies              rental_id, film_id, copy_id, return_date
rented                     rented_copies with customer_id, rental_date
rented_staff               rented with staff_id, store_id
shelf_copies               rented_copies with store_id
shelf_rented               rented with store_id
rentals_with_film          rental_date, film_id; NULL if the film is unknown
stock                      film_id, copy_id, rental_id, return_date, rented; a copy that
                           was never rented has rented = false
shelf_stock                stock with store_id
timed_rentals              ts, staff_id
takings                    rental_id, amount, payment_date
payments                   takings with customer_id
store_payments             takings with customer_id, staff_id, store_id
rental_store_payments      amount, customer_id and store_id of the rental
film_payments              amount, payment_date, film_id
renter_film_payments       film_payments with customer_id of the rental
charges                    payment_id, rental_id, customer_id, amount
rental_revenue             customer_id, rental_date, amount
========================== =========================================================
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.sources import tables

MONEY = "decimal(18,2)"


class Shop:
    """``year``, ``before`` and ``last_day`` are the defaults of the questions' open terms.

    ``slice_bytes`` is how much of a fact's files one task of a join gets.
    """

    schemas: dict[str, str]
    fact: str
    slice_bytes = 2 * 2**20
    references: list[tuple[str, str, str, str]]
    year: int
    before: str
    last_day: str

    def __init__(self, spark: SparkSession, folder: str, as_of: str | None = None):
        self.spark = spark
        self.folder = folder
        self.as_of = as_of or self.last_day

    def verify(self, references: bool = False) -> None:
        """Raise if a table lacks a column or has one of another type; also, if asked, if a parent row is missing.

        Reads the files' footers; the check of references reads the key columns.
        """
        tables.verify(self.spark, self.folder, self.schemas, self.references if references else [])

    def table(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.folder, name, self.schemas)

    def slices(self, parts: int = 1) -> int | None:
        """Tasks over the facts, ``parts`` for each slice of their files; None if every core gets all it can hold."""
        n = parts * -(-tables.stored_bytes(self.spark, self.folder, self.fact) // self.slice_bytes)
        return n if n > self.spark.sparkContext.defaultParallelism else None

    def meet(self, facts: DataFrame, other: DataFrame, key: str) -> DataFrame:
        """Inner join of facts on ``key``, both sides dealt into as many tasks as the facts have slices."""
        n = self.slices()
        return facts.join(other, key) if n is None else facts.repartition(n, key).join(other.repartition(n, key), key)

    @property
    def today(self):
        """The reporting date: a parameter, never the clock."""
        return F.lit(self.as_of).cast("timestamp_ntz")

    def months_ago(self, months: int):
        """Calendar months before the reporting date; the end of a shorter month is kept."""
        return F.add_months(F.lit(self.as_of).cast("date"), -months).cast("timestamp_ntz")


class RentalDatabase(Shop):
    """A rental shop's tables: payment, rental, inventory, film, customer, staff, store, ..."""

    schemas = tables.RENTAL_SCHEMAS
    references = tables.RENTAL_REFERENCES
    fact = "rental"
    year, before, last_day = 2005, "2006-01-01", "2006-02-14"

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("store")

    @cached_property
    def staff(self) -> DataFrame:
        return self.table("staff").join(self.stores, "store_id", "left_semi")

    @cached_property
    def _staff_store(self) -> DataFrame:
        return self.staff.select("staff_id", "store_id")

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select("customer_id", "first_name", "last_name")

    @cached_property
    def signup_stores(self) -> DataFrame:
        return self.table("customer").select("customer_id", "store_id")

    @cached_property
    def films(self) -> DataFrame:
        return self.table("film")

    @cached_property
    def film_category(self) -> DataFrame:
        return self.table("film_category")

    @cached_property
    def films_by_category(self) -> DataFrame:
        return self.films.join(self.film_category, "film_id")

    @cached_property
    def film_actor(self) -> DataFrame:
        # Two actors may share a name, so the number is part of the label.
        label = F.concat("name", F.lit(" ("), F.col("actor_id").cast("string"), F.lit(")"))
        actors = self.table("actor").select("actor_id", label.alias("actor"))
        return self.table("film_actor").join(actors, "actor_id").select("film_id", "actor")

    @cached_property
    def _rental(self) -> DataFrame:
        return self.table("rental").withColumnRenamed("inventory_id", "copy_id")

    @cached_property
    def _inventory(self) -> DataFrame:
        return self.table("inventory").withColumnRenamed("inventory_id", "copy_id")

    @cached_property
    def rentals(self) -> DataFrame:
        return self._rental.select("rental_id", "customer_id", "rental_date")

    @cached_property
    def staffed_rentals(self) -> DataFrame:
        rows = self._rental.select("rental_id", "customer_id", "rental_date", "staff_id")
        return rows.join(self._staff_store, "staff_id")

    @cached_property
    def rented(self) -> DataFrame:
        films = self._inventory.select("copy_id", "film_id")
        return self.meet(self._rental, films, "copy_id")

    @property
    def rented_copies(self) -> DataFrame:
        return self.rented

    @cached_property
    def rented_staff(self) -> DataFrame:
        return self.rented.join(self._staff_store, "staff_id")

    @cached_property
    def shelf_rented(self) -> DataFrame:
        return self.meet(self._rental.drop("staff_id"), self._inventory, "copy_id")

    @property
    def shelf_copies(self) -> DataFrame:
        return self.shelf_rented

    @cached_property
    def rentals_with_film(self) -> DataFrame:
        films = self._inventory.select("copy_id", "film_id")
        return self._rental.join(films, "copy_id", "left").select("rental_date", "film_id")

    @cached_property
    def shelf_stock(self) -> DataFrame:
        rows = self._rental.select("copy_id", "rental_id", "return_date")
        return self._inventory.join(rows, "copy_id", "left").withColumn("rented", F.col("rental_id").isNotNull())

    @property
    def stock(self) -> DataFrame:
        return self.shelf_stock

    @cached_property
    def timed_rentals(self) -> DataFrame:
        return self._rental.select(F.col("rental_date").alias("ts"), "staff_id")

    @cached_property
    def _payment(self) -> DataFrame:
        return self.table("payment")

    @property
    def takings(self) -> DataFrame:
        return self._payment

    @property
    def payments(self) -> DataFrame:
        return self._payment

    @cached_property
    def store_payments(self) -> DataFrame:
        return self._payment.join(self._staff_store, "staff_id")

    @cached_property
    def _paid_rentals(self) -> DataFrame:
        return self._payment.select("rental_id", "amount", "payment_date")

    @cached_property
    def rental_store_payments(self) -> DataFrame:
        return self._paid_rentals.join(self.staffed_rentals, "rental_id").select("amount", "customer_id", "store_id")

    @cached_property
    def renter_film_payments(self) -> DataFrame:
        rentals = self.rented.select("rental_id", "customer_id", "film_id")
        return self._paid_rentals.join(rentals, "rental_id")

    @property
    def film_payments(self) -> DataFrame:
        return self.renter_film_payments

    @cached_property
    def charges(self) -> DataFrame:
        return self._payment.select("payment_id", "rental_id", "customer_id", "amount")

    @cached_property
    def rental_revenue(self) -> DataFrame:
        return self._paid_rentals.join(self.rentals, "rental_id").select("customer_id", "rental_date", "amount")


class OrderShop(Shop):
    """Order tables read as a rental shop."""

    schemas = tables.SCHEMAS
    references = tables.REFERENCES
    fact = "lineitem"
    year, before, last_day = 2000, "2001-01-01", "2001-08-01"

    @cached_property
    def _regions(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("store_id"), "r_name")

    @cached_property
    def stores(self) -> DataFrame:
        return self._regions.select("store_id")

    @cached_property
    def staff(self) -> DataFrame:
        n = self.table("nation")
        return n.join(self._regions, F.col("n_regionkey") == F.col("store_id")).select(
            F.col("n_nationkey").cast("long").alias("staff_id"),
            "store_id",
            F.col("n_name").alias("first_name"),
            F.col("r_name").alias("last_name"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
        )

    @cached_property
    def _customer_staff(self) -> DataFrame:
        """customer_id, staff_id, store_id: the nation of a customer serves them."""
        c = self.table("customer")
        served = c.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").cast("long").alias("staff_id"))
        return served.join(self.staff.select("staff_id", "store_id"), "staff_id")

    @cached_property
    def signup_stores(self) -> DataFrame:
        return self._customer_staff.select("customer_id", "store_id")

    @cached_property
    def films_by_category(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("film_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("category_id"),
            F.col("p_size").alias("allowed_days"),
            (F.col("p_size") + 1950).alias("release_year"),
        )

    @cached_property
    def films(self) -> DataFrame:
        return self.films_by_category.drop("category_id")

    @cached_property
    def film_category(self) -> DataFrame:
        return self.films_by_category.select("film_id", "category_id")

    @cached_property
    def film_actor(self) -> DataFrame:
        actors = F.array_distinct(F.split("title", " "))
        return self.films.select("film_id", F.explode(actors).alias("actor"))

    @cached_property
    def rentals(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("rental_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("rental_date"),
        )

    @cached_property
    def staffed_rentals(self) -> DataFrame:
        return self.rentals.join(self._customer_staff, "customer_id")

    @cached_property
    def _lines(self) -> DataFrame:
        """One row per rented copy, which is also one payment."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("rental_id"),
            F.col("l_partkey").alias("film_id"),
            F.col("l_suppkey").alias("copy_id"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            F.col("l_shipdate").alias("payment_date"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("return_date"),
            (F.col("l_returnflag") != "N").alias("rented"),
        )

    @cached_property
    def rented_copies(self) -> DataFrame:
        return self._lines.select("rental_id", "film_id", "copy_id", "return_date")

    @cached_property
    def rented(self) -> DataFrame:
        return self.meet(self.rented_copies, self.rentals, "rental_id")

    @cached_property
    def rented_staff(self) -> DataFrame:
        return self.rented_copies.join(self.staffed_rentals, "rental_id")

    @cached_property
    def _shelves(self) -> DataFrame:
        """copy_id, store_id: the nation of a supplier is the shelf."""
        s = self.table("supplier").select(
            F.col("s_suppkey").alias("copy_id"), F.col("s_nationkey").cast("long").alias("staff_id")
        )
        return s.join(self.staff.select("staff_id", "store_id"), "staff_id").drop("staff_id")

    @cached_property
    def shelf_copies(self) -> DataFrame:
        return self.meet(self.rented_copies, self._shelves, "copy_id")

    @cached_property
    def shelf_rented(self) -> DataFrame:
        return self.meet(self.rented, self._shelves, "copy_id")

    def _known_film(self, rows: DataFrame, *columns: str) -> DataFrame:
        known = self.films.select("film_id", F.col("film_id").alias("known"))
        joined = rows.select("film_id", *columns).join(known, "film_id", "left")
        return joined.select(*columns, F.col("known").alias("film_id"))

    @cached_property
    def rentals_with_film(self) -> DataFrame:
        return self._known_film(self.rented, "rental_date")

    @cached_property
    def stock(self) -> DataFrame:
        return self._lines.drop("amount", "payment_date")

    @cached_property
    def shelf_stock(self) -> DataFrame:
        return self.meet(self.stock, self._shelves, "copy_id")

    @cached_property
    def timed_rentals(self) -> DataFrame:
        events = self.table("events").select("ts", F.col("user_id").alias("customer_id"))
        return events.join(self._customer_staff, "customer_id").select("ts", "staff_id")

    @cached_property
    def takings(self) -> DataFrame:
        return self._lines.select("rental_id", "amount", "payment_date")

    @cached_property
    def payments(self) -> DataFrame:
        return self.takings.join(self.rentals.select("rental_id", "customer_id"), "rental_id")

    @cached_property
    def store_payments(self) -> DataFrame:
        return self.takings.join(self.staffed_rentals.drop("rental_date"), "rental_id")

    @property
    def rental_store_payments(self) -> DataFrame:
        return self.store_payments

    @cached_property
    def film_payments(self) -> DataFrame:
        return self._lines.select("rental_id", "film_id", "amount", "payment_date")

    @cached_property
    def renter_film_payments(self) -> DataFrame:
        return self.film_payments.join(self.rentals.select("rental_id", "customer_id"), "rental_id")

    @cached_property
    def _priced_orders(self) -> DataFrame:
        price = F.col("o_totalprice").cast(MONEY).alias("amount")
        return self.table("orders").select(
            F.col("o_orderkey").alias("rental_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("rental_date"),
            price,
        )

    @cached_property
    def charges(self) -> DataFrame:
        """Payments with a unique number: lines have none, so one per order."""
        return self._priced_orders.select(F.col("rental_id").alias("payment_id"), "rental_id", "customer_id", "amount")

    @cached_property
    def rental_revenue(self) -> DataFrame:
        return self._priced_orders.select("customer_id", "rental_date", "amount")
