from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelmetrics.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_is_a_bijection_and_has_a_way_back(llm, n):
    x = F.col("id")
    there = llm.range(n).select(x, sharding.permuted(x, F.lit(n), 3).alias("y"))
    back = there.select("id", "y", sharding.permuted(F.col("y"), F.lit(n), 3, forward=False).alias("z")).collect()
    assert sorted(r.y for r in back) == list(range(n))
    assert all(r.id == r.z for r in back)


def test_another_seed_gives_another_order(llm):
    rows = llm.range(500).select(*(sharding.permuted(F.col("id"), F.lit(500), s).alias(f"s{s}") for s in (0, 1))).collect()
    assert sum(r.s0 == r.s1 for r in rows) < 20
    assert sum(abs(a.s0 - b.s0) < 5 for a, b in zip(rows, rows[1:])) < 30


@pytest.mark.parametrize("run", [4096, 3])
def test_documents(documents, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = [(i, "t" * i) for i in range(90)] + [(5, "same é")] * 25 + [(None, None), (None, ""), (None, "x"), (3, None)]
    got = sharding.shard_documents(documents(rows, "1 AS shard"), shards=16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(r.row_no for r in got) == list(range(len(rows)))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_result_does_not_depend_on_partitions(documents):
    docs = documents([(i % 50, f"text {i % 7}") for i in range(300)])
    a, b = (sorted(map(tuple, sharding.shard_documents(d).drop("grown_shard").collect())) for d in (docs, docs.repartition(11)))
    assert a == b


def test_row_can_be_computed_from_shard_and_slot(documents):
    got = sharding.shard_documents(documents([(i, str(i)) for i in range(101)]), shards=4)
    back = got.select("row_no", sharding.row_at(F.col("shard"), F.col("slot"), F.lit(101), 4).alias("r")).collect()
    assert all(r.row_no == r.r for r in back)


def test_fewer_rows_than_shards_and_none(documents):
    got = sharding.shard_documents(documents([(1, "a"), (2, "b")]), shards=16).collect()
    assert [r.slot for r in got] == [0, 0] and len({r.shard for r in got}) == 2
    assert sharding.shard_documents(documents([])).collect() == []
