"""Every query against its defining SQL, and the shape of the catalogue."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as app
import check
from pyspark.sql import functions as F

from conftest import SMALL, rows
from reelmetrics.plans import catalogue
from reelmetrics.sources import tables
from reelmetrics.sources.domain import OrderShop

NAMES = list(catalogue.CATALOGUE)


@pytest.fixture(scope="session")
def duck():
    return check.oracle(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    problem, count = check.compare(app.queries()[name](spark, SMALL), duck, app.oracle_sql()[name])
    assert problem is None


def test_every_question_has_an_entry():
    numbers = {int(re.match(r"q(\d+)", n).group(1)) for n in NAMES}
    assert numbers == set(range(1, 116)) - {81}


def test_every_entry_has_sql():
    assert set(NAMES) <= set(app.oracle_sql()) and set(NAMES) <= set(app.queries())


def test_flagship(spark):
    df = app.entry(spark)
    assert df.columns == ["store_id", "payment_date", "amount", "cumulative_revenue"]
    assert df.count() > 0


def test_references_hold(spark):
    assert {r.orphans for r in tables.orphans(spark, SMALL).collect()} == {0}
    assert len(rows(tables.orphans(spark, SMALL))) == len(tables.REFERENCES)


@pytest.mark.parametrize("name", ["q82", "q83", "q84", "q85"])
def test_layouts_follow_their_source(spark, tmp_path, name):
    """Rows appended to the source are in the next answer."""
    for table in tables.SCHEMAS:
        tables.load(spark, SMALL, table).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    run = lambda: sorted(map(str, app.queries()[name](spark, str(tmp_path)).collect()))
    before = run()
    assert before == run() == sorted(map(str, app.queries()[name](spark, SMALL).collect()))
    twice = {"q82": "orders", "q83": "customer", "q84": "lineitem", "q85": "lineitem"}[name]
    tables.load(spark, SMALL, twice).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{twice}.parquet")
    after = run()
    assert after != before and (name != "q83" or len(after) == 2 * len(before))


def test_a_missing_column_raises(spark, tmp_path):
    for table in tables.SCHEMAS:
        df = tables.load(spark, SMALL, table)
        (df.drop("o_orderdate") if table == "orders" else df).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    with pytest.raises(ValueError, match="orders.o_orderdate is missing"):
        OrderShop(spark, str(tmp_path)).verify()
    OrderShop(spark, SMALL).verify(references=True)
    with pytest.raises(ValueError, match="orders.o_orderdate is missing"):  # also of a query by itself
        app.queries()["q2"](spark, str(tmp_path))
    assert app.queries()["q51"](spark, str(tmp_path)).columns  # which reads no orders


def test_a_column_of_another_type_raises_on_load(spark, tmp_path):
    df = tables.load(spark, SMALL, "region")
    df.withColumn("r_regionkey", F.col("r_regionkey").cast("string")).write.parquet(f"{tmp_path}/region.parquet")
    with pytest.raises(ValueError, match="region.r_regionkey is string, not int"):
        tables.load(spark, str(tmp_path), "region")


def test_an_orphan_raises(spark, tmp_path):
    for table in tables.SCHEMAS:
        df = tables.load(spark, SMALL, table)
        (df.filter("c_custkey <> 5") if table == "customer" else df).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    OrderShop(spark, str(tmp_path)).verify()
    with pytest.raises(ValueError, match="orders.o_custkey has"):
        OrderShop(spark, str(tmp_path)).verify(references=True)
