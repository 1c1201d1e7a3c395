from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmetrics.llm import negatives

NAN, INF = float("nan"), float("inf")
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.fixture
def vectors(llm):
    schema = "vec_id long, embedding array<double>, label int, n int, slab string, row string"
    return lambda rows: llm.createDataFrame([(*r, 1, "x", "y") for r in rows], schema).repartition(3)


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (anchor, v, label) in enumerate(good):
        if anchor is None or anchor % every:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i, x) for j, (i, w, x) in enumerate(good) if j != k and len(w) == len(v)),
            key=lambda s: s[:3],
        )
        for p in [s for s in scored if s[4] == label][:positives]:
            fits = [s for s in scored if s[4] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(anchor, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(fits[:negatives], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x or 0) for x in r))


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def random_rows(n, d, seed, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.3
    if centres:
        x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + x * 0.1
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, 4, n)))]


def test_equals_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(negatives, "NODE", 256)
    rows = random_rows(900, 6, 1, centres=9)
    rows += [(900 + i, rows[0][1], 1) for i in range(300)]  # one hot vector, with ids that are anchors too
    assert result(negatives.mined(vectors(rows))) == brute(rows)


def test_nulls_ties_repeated_rows_lengths_and_signs(vectors):
    rows = [(100 * i, [0.1 * i, -0.2], i % 2) for i in range(8)]
    rows += [(1, [0.3, 0.1], None), (2, None, 1), (3, [0.1, None], 0), (4, [NAN, 0.1], 1), (5, [INF, 1.0], 1), (6, [], 1), (300, [], 0)]
    rows += [(None, [0.5, -0.2], 0), (None, [0.5, -0.2], 1), (7, [0.5], 0), (400, [0.5], 0), (9, [0.4], 1), (11, [0.2], 1)]
    rows += [(700, [0.7, -0.2], 1)] * 2 + [(13, [-1.0, -3.0], 0), (14, [0.0, 0.0], 1), (15, [0.0, 0.0], 1)]
    assert result(negatives.mined(vectors(rows))) == brute(rows)


def test_blocks_are_not_gathered_in_the_driver(vectors):
    """The blocks are small as files, but a row for each slab; neither they nor the positives may be broadcast."""
    rows = random_rows(400, 4, 3)
    df = negatives.mined(vectors(rows))
    assert result(df) == brute(rows) != []
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("SortMergeJoin") >= 2 and "Broadcast" not in text


def test_empty_table_and_no_anchor(vectors):
    assert negatives.mined(vectors([])).collect() == []
    assert negatives.mined(vectors([(1, [0.1], 1), (2, [0.2], 0)])).collect() == []


def test_scores_beyond_doubles_and_longs(vectors):
    big = 2.0**22 + 1 / 256
    rows = [(100, [big, 1.0], 0), (101, [big, 3.0], 0), (102, [big / 2, 1.0], 1), (103, [big / 2 - 1 / 256, 2.0], 1)]
    assert result(negatives.mined(vectors(rows))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        negatives.mined(vectors([(100, [1e30], 1)])).collect()


def test_given_vectors(llm):
    df = llm.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(negatives.mined(df, every=20)) == brute(rows, every=20)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(0, 10**6))
def test_boxes_hold_their_rows_and_intervals_their_scores(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-50, 50, (n, d)).astype(np.int32)
    order = negatives.str_order(x, 16)
    assert sorted(np.concatenate(order).tolist()) == list(range(n))
    assert all(len(o) <= 16 for o in order) and sum(len(o) < 16 for o in order) <= 1 + len(order) // 4 + n // 16
    take = np.concatenate(order)
    starts = np.cumsum([0, *(len(o) for o in order)])[:-1]
    low, high = negatives.boxes(x[take], starts)
    least, most = negatives.intervals(rng.integers(-50, 50, (3, d)), low, high)
    anchors = rng.integers(-50, 50, (3, d))
    least, most = negatives.intervals(anchors, low, high)
    for k, rows in enumerate(order):
        scores = anchors @ x[rows].T
        assert (least[:, k] <= scores.min(1)).all() and (scores.max(1) <= most[:, k]).all()


def test_search_opens_few_boxes_of_clustered_vectors():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(64, 8))[np.repeat(np.arange(64), 64)] * 200 + rng.normal(size=(4096, 8)) * 4).astype(np.int32)
    order = negatives.str_order(x, 64)
    take = np.concatenate(order)
    n = len(x)
    node = negatives.Node(np.arange(n), np.ones(n, bool), np.zeros(n, int), np.arange(n), x[take], np.array([len(o) for o in order]))
    opened, boxes = 0, 0
    for k in range(0, n, 97):
        inner, leaf = negatives.intervals(node.x[k : k + 1], *node.inner_boxes), negatives.intervals(node.x[k : k + 1], *node.leaf_boxes)
        box = (inner[0][0], inner[1][0]), (leaf[0][0], leaf[1][0])
        got = negatives.search(node, node.x[k], k, 0, True, [(negatives.LEAST, negatives.MOST, negatives.LEAST)], 5, *box)
        scores = node.x.astype(int) @ node.x[k].astype(int)
        scores[k] = negatives.LEAST
        assert got.scores[0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
        opened, boxes = opened + got.opened, boxes + len(node.starts) + len(node.inner)
        # A window below the best: boxes wholly above it are not opened either.
        low, high = int(np.quantile(scores, 0.5)), int(np.quantile(scores, 0.6))
        got = negatives.search(node, node.x[k], k, 1, False, [(low, high, negatives.LEAST)], 10, *box)
        assert got.scores[0].tolist() == sorted((s for s in scores.tolist() if low <= s <= high), reverse=True)[:10]
    assert opened < 0.5 * boxes
