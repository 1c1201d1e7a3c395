from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmetrics.llm import neighbours

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(llm):
    return lambda rows: llm.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string").repartition(3)


def test_step_sets_come_in_order_of_cost():
    m = 4
    sets = neighbours.step_sets(m, 40)
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    valid = [c for n in range(m + 1) for c in itertools.combinations(range(2 * m), n) if not any(2 * m - 1 - j in c for j in c)]
    want = sorted(sum(cost[j] for j in c) for c in valid)[:40]
    assert np.allclose([sum(np.array(cost) * s) for s in sets], want)
    assert len({tuple(s) for s in sets}) == 40 and not sets[0].any()


def test_probed_buckets_are_those_of_moved_points():
    rng = np.random.default_rng(0)
    hashes = neighbours.Hashes.drawn(8, 2.0, tables=2, projections=5)
    x = rng.normal(size=(20, 8))
    probed = hashes.probed(x, 1, neighbours.step_sets(5, 11))
    assert (probed[:, 0] == hashes.buckets(x, 1)).all()
    places = hashes.places(x, 1)
    for i in range(20):
        down = places[i] - np.floor(places[i])
        j = int(np.argmin(np.concatenate([down, 1 - down])))
        moved = np.floor(places[i])
        moved[j % 5] += -1 if j < 5 else 1
        assert probed[i, 1] == (moved.astype(np.int64) * hashes.codes[1]).sum()


def brute(rows, query_id, k=10):
    query = next(v for i, v in rows if i == query_id)
    found = sorted((math.dist(np.float32(query).astype(float), np.float32(v).astype(float)), i) for i, v in rows if i != query_id)
    return found[:k]


def test_recall_and_scores(vectors):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got = neighbours.nearest_of_table(vectors(rows)).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        want = brute(rows, q)
        hits += len({r.vec_id for r in mine} & {i for _, i in want})
        exact = {i: d for d, i in brute(rows, q, 3000)}
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
    assert hits / 300 >= 0.9


def recall(rows, got, queries):
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == ids[q]} & set(ids[np.argsort(d)[:10]].tolist()))
    return hits / (10 * len(queries))


@pytest.mark.parametrize("share", [3, 50])
def test_a_denser_source_first_in_the_file(llm, share):
    """The first rows, or all but the last fiftieth, lie closer than the others; both are found alike."""
    rng = np.random.default_rng(8)
    n = 9000
    dense = n // 3 if share == 3 else n - n // share
    centres = 3 * rng.normal(size=(40, 32))
    spread = np.where(np.arange(n) < dense, 0.5, 1.0 if share == 3 else 2.0)
    x = (centres[rng.integers(0, 40, n)] + spread[:, None] * rng.normal(size=(n, 32))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = [*range(0, dense, 100), *range(dense, n, 10 if share == 50 else 100)]
    got = neighbours.search(df, df.filter(F.col("vec_id").isin(queries))).collect()
    assert recall(rows, got, queries[-10:]) >= 0.9
    assert recall(rows, got, [q for q in queries if q >= dense]) >= 0.9
    assert recall(rows, got, [q for q in queries if q < dense]) >= 0.9


def test_all_rows_are_searched_without_a_fit(vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 1.1)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).astype(np.float32).astype(float).tolist()) for i in range(500)]
    got = neighbours.nearest_of_table(vectors(rows)).collect()
    assert recall(rows, got, range(0, 500, 100)) == 1


def test_ties_bad_vectors_and_few_rows(vectors):
    rows = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (4, [0.0, 1.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    bad = [(1, None), (2, [0.0, 0.0]), (3, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, None]), (8, [1.0, 1.0, 1.0]), (10, []), (None, [1.0, 0.1]), (100, None), (200, [0.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_of_table(vectors(rows + bad)).collect()]
    assert sorted(got) == [(0, 1, 9, 1.0), (0, 2, 9, 1.0), (0, 3, 4, math.sqrt(2)), (0, 4, 5, math.sqrt(2))]


def test_a_third_of_all_rows_are_one_vector(vectors):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)]
    got = neighbours.nearest_of_table(vectors(rows)).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 300] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_blocks_of_queries_do_not_matter(vectors):
    rng = np.random.default_rng(5)
    df = vectors([(i, rng.normal(size=4).tolist()) for i in range(60)])
    one, many = (sorted(map(tuple, neighbours.search(df, df.filter("vec_id % 10 = 0"), 5, block).collect())) for block in (1024, 2))
    assert one == many and len(one) == 30


def test_empty_tables(vectors):
    assert neighbours.nearest_of_table(vectors([])).collect() == []
    assert neighbours.nearest_of_table(vectors([(1, [1.0]), (2, [2.0])])).collect() == []
    assert neighbours.nearest_of_table(vectors([(0, [1.0])])).collect() == []
