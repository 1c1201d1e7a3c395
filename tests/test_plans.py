"""Physical plans: what must be pushed down, limited early, or not shuffled."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as app
from conftest import SMALL
from reelmetrics.plans import catalogue, layouts
from reelmetrics.sources import layout
from reelmetrics.sources.domain import OrderShop


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan_of(spark, name):
    return plan(app.queries()[name](spark, SMALL))


@pytest.fixture
def no_broadcast(spark):
    """Plan as for tables far above the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(catalogue.CATALOGUE))
def test_no_cross_join_and_no_python(spark, name):
    text = plan_of(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text


@pytest.mark.parametrize("name", ["q75", "q47", "q88", "q114", "q69", "q15"])
def test_best_few_are_limited_before_the_shuffle(spark, name):
    text = plan_of(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)


@pytest.mark.parametrize("name", ["q26", "q30", "q39"])
def test_first_row_is_taken_without_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan_of(spark, name)


@pytest.mark.parametrize("name", ["q6", "q17", "q44", "q92"])
def test_date_filter_reaches_the_scan(spark, name):
    text = plan_of(spark, name)
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThan|LessThan)", text)


WITHOUT_JOBS = ["q2", "q3", "q21", "q21_intent", "q23", "q24", "q24_intent", "q71", "q72a", "q72b", "q86", "q87", "q93", "q99", "q100"]


@pytest.mark.parametrize("name", WITHOUT_JOBS)
def test_building_a_plan_runs_no_job(spark, name):
    app.queries()[name](spark, SMALL)  # the first use of a table looks at its files' schema
    spark.sparkContext.setJobGroup(f"build {name}", name)
    app.queries()[name](spark, SMALL)
    spark.sparkContext.setJobGroup("other", "other")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}")


@pytest.mark.parametrize("name", ["q11", "q12a", "q13", "q14", "q31", "q32", "q43", "q52", "q74", "q89", "q90", "q96"])
def test_no_broadcast_is_forced(spark, no_broadcast, name):
    assert "BroadcastExchange" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["q95", "q104", "q104_category"])
def test_months_of_a_key_are_neither_made_distinct_nor_numbered(spark, name):
    text = plan_of(spark, name)
    assert "Window" not in text and "year_month" not in text
    assert len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[\]", text)) == 0


@pytest.mark.parametrize("name", ["q94", "q105", "q66"])
def test_facts_are_not_sorted_for_an_aggregate(spark, name):
    assert "SortAggregate" not in plan_of(spark, name)


def test_rentals_are_counted_before_they_meet_the_actors(spark, no_broadcast):
    text = plan_of(spark, "q66")
    assert text.index("Generate explode") < len(text) and re.search(r"HashAggregate\(keys=\[customer_id#\d+L, film_id", text)


@pytest.mark.parametrize("name", ["q1", "q4", "q5", "q22", "q78"])
def test_no_single_partition_over_facts(spark, name):
    """A single-partition exchange may only follow an aggregate."""
    lines = plan_of(spark, name).splitlines()
    for i, text in enumerate(lines):
        if "Exchange SinglePartition" in text:
            assert "Aggregate" in lines[i + 1] or "Aggregate" in lines[i + 2]


def test_scan_reads_only_needed_columns(spark):
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan_of(spark, "q2")).group(1)
    assert schema == "struct<o_custkey:bigint,o_orderdate:timestamp_ntz>"


@pytest.mark.parametrize("name", ["q82", "q85"])
def test_month_partitions_are_pruned_by_the_joined_months(spark, name):
    """The months are no literals of the query; the scan learns them from the join and opens their folders only."""
    df = app.queries()[name](spark, SMALL)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", final)


def test_name_filter_is_pushed(spark):
    assert "EqualTo(last_name,BUILDING)" in plan_of(spark, "q83")


def rows_scanned(df):
    """Rows that the one scan of a collected plan gave on."""
    node = df._jdf.queryExecution().executedPlan()
    while "FileScan" not in node.nodeName() and not node.nodeName().startswith("Scan"):
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("bloom", [True, False])
def test_row_groups_are_skipped_by_bloom_filters(spark, tmp_path, bloom):
    """Names in no order over many row groups: without the filters each row group's range holds the name."""
    names = F.md5(F.col("id").cast("string")).alias("name")
    df = spark.range(0, 40_000, 1, 2).select("id", names).orderBy(F.xxhash64("id")).coalesce(1)
    spark.conf.set("parquet.block.row.count.limit", "2000")
    try:
        if bloom:
            layout.bloom_files(df, "name", 2000, f"{tmp_path}/f")
        else:
            df.write.parquet(f"{tmp_path}/f")
    finally:
        spark.conf.unset("parquet.block.row.count.limit")
    wanted = hashlib.md5(b"77").hexdigest()
    found = spark.read.parquet(f"{tmp_path}/f").filter(F.col("name") == wanted)
    assert [r.id for r in found.collect()] == [77]
    assert (rows_scanned(found) <= 4000) == bloom


def test_bucketed_join_has_no_shuffle(spark, no_broadcast):
    rentals, stock = layouts.bucketed_tables(OrderShop(spark, SMALL))
    text = plan(rentals.join(stock, ["film_id", "copy_id"]))
    assert "SortMergeJoin" in text and "Exchange" not in text


ONE_SCAN = ["q1", "q4", "q5", "q11", "q12a", "q12b", "q13", "q25", "q29", "q32", "q33", "q34", "q43", "q52", "q74", "q77", "q91", "q96", "q98", "q99"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_branches_share_one_scan_of_the_facts(spark, no_broadcast, name):
    df = app.queries()[name](spark, SMALL)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("l_orderkey") > 0 or "l_partkey" in final
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_(?:orderkey|partkey)", final)) == 1
