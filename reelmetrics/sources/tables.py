"""The base tables: explicit schemas, read lazily from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# A rental shop's own tables, for RentalDatabase.
RENTAL_SCHEMAS = {
    "store": "store_id bigint",
    "staff": "staff_id bigint, store_id bigint, first_name string, last_name string",
    "customer": "customer_id bigint, first_name string, last_name string, store_id bigint",
    "film": "film_id bigint, title string, allowed_days int, release_year int",
    "category": "category_id bigint, name string",
    "film_category": "film_id bigint, category_id bigint",
    "actor": "actor_id bigint, name string",
    "film_actor": "actor_id bigint, film_id bigint",
    "inventory": "inventory_id bigint, film_id bigint, store_id bigint",
    "rental": (
        "rental_id bigint, rental_date timestamp_ntz, inventory_id bigint, customer_id bigint, "
        "staff_id bigint, return_date timestamp_ntz"
    ),
    "payment": (
        "payment_id bigint, rental_id bigint, customer_id bigint, staff_id bigint, "
        "amount decimal(18,2), payment_date timestamp_ntz"
    ),
}

# child table, child column, parent table, parent column
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
RENTAL_REFERENCES = [
    ("staff", "store_id", "store", "store_id"),
    ("film_category", "film_id", "film", "film_id"),
    ("film_actor", "film_id", "film", "film_id"),
    ("inventory", "film_id", "film", "film_id"),
    ("rental", "inventory_id", "inventory", "inventory_id"),
    ("rental", "customer_id", "customer", "customer_id"),
    ("rental", "staff_id", "staff", "staff_id"),
    ("payment", "rental_id", "rental", "rental_id"),
    ("payment", "staff_id", "staff", "staff_id"),
]


_checked: set[tuple[str, str, str]] = set()


def load(spark: SparkSession, folder: str, name: str, schemas: dict[str, str] = SCHEMAS) -> DataFrame:
    """The table, after a look at its files' schema: a missing column, or one of another type, raises ValueError.

    With the schema given, a column that a file lacks would read as NULL. An application looks once at each table.
    """
    key = (spark.sparkContext.applicationId, f"{folder}/{name}", schemas[name])
    if key not in _checked:
        wrong = differences(spark, folder, name, schemas[name])
        if wrong:
            raise ValueError("; ".join(wrong))
        _checked.add(key)
    return spark.read.schema(schemas[name]).parquet(f"{folder}/{name}.parquet")


def stored_bytes(spark: SparkSession, folder: str, name: str) -> int:
    """Length of the table's files, off their listing; no job runs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def differences(spark: SparkSession, folder: str, name: str, schema: str) -> list[str]:
    """What columns of the schema the table's files lack or hold with another type."""
    found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{folder}/{name}.parquet").schema}
    columns = (c.split() for c in schema.split(", "))
    return [f"{name}.{c} is {found.get(c, 'missing')}, not {kind}" for c, kind in columns if found.get(c) != kind]


def orphans(spark: SparkSession, folder: str, schemas=SCHEMAS, references=REFERENCES) -> DataFrame:
    """Rows whose parent is missing, counted per reference.

    The catalogue drops or delays a join whose only effect is an existence check. Run this on a
    new load; the shortcuts are valid while every count is zero.
    """
    counts = None
    for child, column, parent, key in references:
        rows = load(spark, folder, child, schemas).dropna(subset=[column])
        keys = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
        parents = load(spark, folder, parent, schemas).select(F.col(key).alias("key"))
        missing = keys.join(parents, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        row = missing.select(F.lit(f"{child}.{column}").alias("reference"), "orphans")
        counts = row if counts is None else counts.unionByName(row)
    return counts


def verify(spark: SparkSession, folder: str, schemas: dict[str, str], references=()) -> None:
    """Raise ValueError for a missing column, a column of another type, or a reference without its parent, in any table."""
    wrong = [x for name, schema in schemas.items() for x in differences(spark, folder, name, schema)]
    if not wrong and references:
        rows = orphans(spark, folder, schemas, list(references)).filter("orphans > 0").collect()
        wrong = [f"{r.reference} has {r.orphans} rows without a parent" for r in rows]
    if wrong:
        raise ValueError("; ".join(wrong))
