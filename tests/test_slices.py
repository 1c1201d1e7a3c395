from __future__ import annotations

import random

import pytest

from reelmetrics.operators.pairs import frequent_pairs
from reelmetrics.plans.catalogue import CATALOGUE
from tests.conftest import line, order, rows
from tests.test_cohorts import brute_pairs

# Six customers rent films 1 and 2; one line comes twice, some keys are null or unknown.
ORDERS = [order(k, k % 6 + 1, "2000-05-01") for k in range(18)] + [order(None, 1, "2000-05-01"), order(90, None, "2000-05-01")]
LINES = [line(k, k // 6 % 2 + 1, k % 2 + 1, 1.0, "2000-05-03", returned=k % 3 > 0) for k in range(18)]
LINES += [LINES[0], line(90, 1, 1, 1.0, "2000-05-03"), line(90, 1, 2, 1.0, "2000-05-03"), line(3, None, 1, 1.0, "2000-05-03")]
LINES += [line(None, 2, 2, 1.0, "2000-05-03"), line(4, 2, None, 1.0, "2000-05-03"), line(77, 1, 9, 1.0, "2000-05-03")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "joins", "parts"), [("q52", 1, 1), ("q53", 1, 1), ("q66", 2, 1), ("q99", 1, 4)])
def test_facts_meet_in_slices_of_their_files(shop, name, joins, parts):
    whole = shop(orders=ORDERS, lineitem=LINES)
    assert whole.slices() is None  # every core can hold its share
    sliced = shop(orders=ORDERS, lineitem=LINES)
    sliced.slice_bytes = 512
    n = sliced.slices()
    assert n > 4
    got = CATALOGUE[name].build(sliced)
    text = plan(got)
    assert text.count(f", {n}), REPARTITION_BY_NUM") >= 2 * joins
    assert text.count(f", {parts * n}), REPARTITION_BY_NUM") >= 2
    assert rows(got) == rows(CATALOGUE[name].build(whole)) != []


def test_slices_grow_with_the_files_and_not_with_the_cores(shop):
    small, large = shop(lineitem=LINES), None
    small.slice_bytes = 256
    n = small.slices()
    large = shop(lineitem=[line(k, 17 * k % 1009, 31 * k % 997, k / 7, "2000-05-03") for k in range(20_000)])
    large.slice_bytes = 256
    assert large.slices() > 10 * n
    assert large.slices(parts=4) == 4 * large.slices()


def test_pairs_meet_in_the_given_number_of_tasks(spark):
    df = spark.createDataFrame([(c, i) for c in range(9) for i in range(c % 4 + 2)] + [(None, 1), (1, None), (1, 0)], "c long, i long")
    got = frequent_pairs(df, "c", "i", 3, block=2, slices=7)
    assert plan(got).count(", 7), REPARTITION_BY_NUM") == 2
    assert rows(got) == rows(frequent_pairs(df, "c", "i", 3, block=2)) != []


def shuffled_rows(node):
    """Rows written by each shuffle of a collected plan."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(node.plan())
    below = [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    return sum(map(shuffled_rows, below), own)


def test_pairs_are_not_shuffled_one_by_one(spark):
    """40 baskets of 60 of 600 items make 70,800 pairs, and a list for each item of a basket at most."""
    rng = random.Random(8)
    baskets = {c: set(rng.sample(range(600), 60)) for c in range(40)}
    df = spark.createDataFrame([(c, i) for c, b in baskets.items() for i in b], "c long, i long")
    got = frequent_pairs(df, "c", "i", 3, slices=7)
    assert rows(got) == brute_pairs(baskets, 3) != []
    assert 0 < max(shuffled_rows(got._jdf.queryExecution().executedPlan())) <= 40 * 60


KINDS = {
    "bigint": lambda i: (i - 20) * 2**58 + i * 7919,
    "int": lambda i: (i - 20) * 2**25 + i,
    "smallint": lambda i: i * 811 - 2**14,
    "tinyint": lambda i: i - 20,
    "string": lambda i: f"x{i}",
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_lists_give_the_same_pairs_for_items_of_any_kind(spark, kind, block):
    """Also below zero, beyond three bytes, and where blocks meet; the least items are in nearly every basket."""
    rng = random.Random(block)
    baskets = {c: {KINDS[kind](min(rng.randrange(40), rng.randrange(40))) for _ in range(rng.randrange(30))} for c in range(30)}
    df = spark.createDataFrame([(c, i) for c, b in baskets.items() for i in b] + [(None, KINDS[kind](1)), (1, None)], f"c bigint, i {kind}")
    got = frequent_pairs(df, "c", "i", 3, block=block, slices=3)
    assert rows(got) == brute_pairs(baskets, 3) != []
    assert got.dtypes == frequent_pairs(df, "c", "i", 3, block=block).dtypes
