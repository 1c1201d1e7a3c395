"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the whole parts of several shifted Gaussian projections, in units of a width. Near
vectors differ little in a projection, so they share the bucket or lie in one next to it. A query visits, besides
its own bucket, those reached by steps over the nearest boundaries: sets of steps in the order of their expected
squared distances, which is the order of estimated success. The candidates of all tables are merged, and ranked by
their exact Euclidean distance in double precision.

Every row is hashed and compared with the probes of a block of queries where it is read. A task hands on the best
few of its rows for each query, so neither a bucket's rows nor the candidate pairs are gathered anywhere, whatever
their number. Searched again over all rows are queries with fewer candidates than asked for, and those whose last
neighbour found is farther off than the distances that the width was fitted to. Without a fit, all are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.shared import below_share, written

NEAREST, EVERY = 10, 100
TABLES, PROJECTIONS, PROBES = 10, 16, 150
# The bounded sample that the width is fitted on, and the share of true neighbours to be found in it: of all, and of
# each tenth of them by distance. Among all rows the neighbours are nearer and the share found is higher; the README
# has figures.
SAMPLE, SAMPLE_QUERIES, RECALL, RECALL_OF_TENTH = 2000, 500, 0.95, 0.92
# Queries of a block; rows that are compared at once; pairs whose distances are held at once.
QUERIES, ROWS, PAIRS = 1024, 2048, 1 << 16
SEED = 7


def step_sets(projections: int, probes: int) -> np.ndarray:
    """The first ``probes`` sets of steps, the empty one first, as 0/1 rows over the 2 M boundaries by nearness.

    Boundary j (from 1) of M projections has the expected squared distance j (j + 1) / (4 (M + 1) (M + 2)), and
    1 - (2 M + 1 - j) / (M + 1) + (2 M + 1 - j) (2 M + 2 - j) / (4 (M + 1) (M + 2)) beyond M. Boundaries j and
    2 M + 1 - j are the two sides of one projection; a set has at most one of them.
    """
    m = projections
    j = np.arange(1, 2 * m + 1)
    other = 2 * m + 1 - j
    near, far = j * (j + 1) / (4 * (m + 1) * (m + 2)), other * (other + 1) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, 1 - other / (m + 1) + far)
    chosen: list[tuple[int, ...]] = [()]
    queue = [(float(cost[0]), (0,))]
    while queue and len(chosen) < probes:
        total, steps = heapq.heappop(queue)
        if len({min(s, 2 * m - 1 - s) for s in steps}) == len(steps):
            chosen.append(steps)
        last = steps[-1] + 1
        if last < 2 * m:  # the set with its last step moved on, and with one more step
            heapq.heappush(queue, (total - float(cost[last - 1]) + float(cost[last]), (*steps[:-1], last)))
            heapq.heappush(queue, (total + float(cost[last]), (*steps, last)))
    sets = np.zeros((len(chosen), 2 * m), np.int64)
    for i, steps in enumerate(chosen):
        sets[i, list(steps)] = 1
    return sets


@dataclass(frozen=True)
class Hashes:
    directions: np.ndarray  # [table, dimension, projection]
    shifts: np.ndarray  # [table, projection], in widths
    codes: np.ndarray  # odd 64-bit factors that make one number of a bucket's coordinates
    width: float

    @staticmethod
    def drawn(dimension: int, width: float, tables: int = TABLES, projections: int = PROJECTIONS) -> Hashes:
        rng = np.random.default_rng(SEED)
        return Hashes(
            rng.normal(size=(tables, dimension, projections)),
            rng.uniform(size=(tables, projections)),
            rng.integers(-(2**62), 2**62, size=(tables, projections)) * 2 + 1,
            width,
        )

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.directions[table] / self.width + self.shifts[table]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(self.places(x, table)).astype(np.int64) * self.codes[table]).sum(1)

    def probed(self, queries: np.ndarray, table: int, sets: np.ndarray) -> np.ndarray:
        """[query, probe]: the buckets that each query visits, in order."""
        places = self.places(queries, table)
        whole = np.floor(places)
        down = places - whole
        nearness = np.argsort(np.concatenate([down, 1 - down], 1), axis=1, kind="stable")
        steps = np.concatenate([-self.codes[table], self.codes[table]])[nearness]
        return (whole.astype(np.int64) * self.codes[table]).sum(1)[:, None] + steps @ sets.T


class Probes:
    """The buckets that a block of queries visits, to be met by rows."""

    def __init__(self, hashes: Hashes, queries: np.ndarray, probes: int = PROBES):
        sets = step_sets(hashes.codes.shape[1], probes)
        self.hashes, self.n = hashes, len(queries)
        self.keys, self.owners = [], []
        for t in range(len(hashes.codes)):
            keys = hashes.probed(queries, t, sets)
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys.append(keys.ravel()[order])
            self.owners.append((order // keys.shape[1]).astype(np.int32))

    def candidates(self, rows: np.ndarray) -> np.ndarray:
        """[query, row]: whether any table has the row in a visited bucket."""
        met = np.zeros((self.n, len(rows)), bool)
        for t, (keys, owners) in enumerate(zip(self.keys, self.owners)):
            bucket = self.hashes.buckets(rows, t)
            first, last = np.searchsorted(keys, bucket, "left"), np.searchsorted(keys, bucket, "right")
            n = last - first
            row = np.repeat(np.arange(len(rows)), n)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            met[owners[entry], row] = True
        return met


def distances(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(q))
    for a in range(0, len(q), PAIRS):
        apart = queries[q[a : a + PAIRS]] - rows[r[a : a + PAIRS]]
        out[a : a + PAIRS] = np.sqrt((apart * apart).sum(1))
    return out


class Best:
    """The nearest rows of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, nearest: int):
        self.nearest = nearest
        self.q, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit = np.full(n, np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        near = d <= self.limit[q]
        q, ids, d = (np.concatenate(x) for x in ((self.q, q[near]), (self.id, ids[near]), (self.d, d[near])))
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        kept = rank < self.nearest
        self.limit[q[rank == self.nearest - 1]] = d[rank == self.nearest - 1]
        self.q, self.id, self.d = q[kept], ids[kept], d[kept]


def dimension_of(vectors: DataFrame) -> int | None:
    """The commonest length of a vector; the smaller of two that are equally common."""
    sizes = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count()
    found = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return found[0].n if found else None


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, embedding) of the rows that take part.

    Left out are rows without an id, and vectors that are null, zero, of another length than the commonest, or hold
    null or non-finite components.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    kept = F.col("vec_id").isNotNull() & (F.size("embedding") == dimension) & ~bad & some
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    return vectors.filter(kept).select(F.col("vec_id").cast("long").alias("vec_id"), vector)


def fitted(vectors: DataFrame, dimension: int) -> tuple[Hashes, float] | None:
    """Hashes that find the wanted share of neighbours within a sample of about SAMPLE vectors, and their reach.

    The sample, and the queries in it, are those of least hash, wherever they lie in the files. The share is reached
    for the neighbours farthest from their queries too; the reach is the distance that all but a twentieth of them
    are within. Neighbours in all rows are nearer than in a sample of them, so they are found at least as often. None
    if no width does it.
    """
    n = vectors.count()
    share = min(1.0, SAMPLE / max(n, 1))
    h = F.xxhash64("vec_id", "embedding", F.lit(SEED)).alias("_h")
    drawn = vectors.select("embedding", h).filter(below_share(F.col("_h"), F.lit(share)))
    rows = drawn.orderBy(F.xxhash64("_h", F.lit(SEED))).limit(2 * SAMPLE).select("embedding").collect()
    x = np.array([r.embedding for r in rows], float).reshape(-1, dimension)
    if len(x) < 3:
        return None
    queries = x[: min(SAMPLE_QUERIES, len(x))]
    square = (queries**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * queries @ x.T
    square[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(NEAREST, len(x) - 1)
    nearest = np.argpartition(square, k - 1, axis=1)[:, :k]
    far = np.sqrt(np.take_along_axis(square, nearest, 1).clip(0))
    order = np.argsort(far, axis=None, kind="stable")
    width = max(float(np.median(far.max(1))), 1e-9)
    for _ in range(24):
        hashes = Hashes.drawn(dimension, width)
        met = np.take_along_axis(Probes(hashes, queries).candidates(x), nearest, 1)
        tenths = np.array_split(met.ravel()[order], 10)
        if met.mean() >= RECALL and min(t.mean() for t in tenths if len(t)) >= RECALL_OF_TENTH:
            return hashes, float(np.quantile(far, 0.95))
        width *= 1.15
    return None


def _scan(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, hashes: Hashes | None, nearest: int) -> DataFrame:
    """(query, vec_id, score): the nearest of every task's rows, for each query; without hashes all rows compete."""
    probes = Probes(hashes, queries) if hashes is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), nearest)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                row_ids = part.column(0).to_numpy()
                rows = part.column(1).flatten().to_numpy().reshape(len(row_ids), -1)
                met = probes.candidates(rows) if probes is not None else np.ones((len(queries), len(rows)), bool)
                met &= ids[:, None] != row_ids[None, :]
                q, r = np.nonzero(met)
                best.add(q, row_ids[r], distances(queries, rows, q, r))
        yield pa.RecordBatch.from_arrays([pa.array(best.q), pa.array(best.id), pa.array(best.d)], names=["query", "vec_id", "score"])

    return vectors.mapInArrow(run, "query long, vec_id long, score double")


def _ranked(found: DataFrame, ids: np.ndarray, nearest: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    named = found.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "query long, query_id long")
    return ranked.join(F.broadcast(named), "query")  # at most a block of queries


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest found, nearest first, ties to the smaller id.

    ``vectors`` and ``queries`` have vec_id and embedding; rows of a query's own id are no candidates for it.
    Queries are taken in blocks. Equal rows are candidates, or queries, of their own. Without usable vectors, or
    without queries, the result is empty.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    dimension = dimension_of(vectors)
    if dimension is None:
        return spark.createDataFrame([], schema)
    vectors, queries = usable(vectors, dimension), usable(queries, dimension)
    fit = fitted(vectors, dimension)
    results = []

    def search_block(ids: list[int], rows: list[list[float]]) -> None:
        names, x = np.array(ids, np.int64), np.array(rows, float).reshape(-1, dimension)
        if fit is None:
            results.append(_ranked(_scan(vectors, names, x, None, nearest), names, nearest))
            return
        hashes, reach = fit
        found = written(_ranked(_scan(vectors, names, x, hashes, nearest), names, nearest), "neighbours")
        last = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far"))
        full = {r.query for r in last.filter((F.col("n") >= nearest) & (F.col("far") <= reach)).select("query").collect()}
        short = np.array([k not in full for k in range(len(names))])
        results.append(found.filter(~F.col("query").isin([int(k) for k in np.flatnonzero(short)])) if short.any() else found)
        if short.any():
            results.append(_ranked(_scan(vectors, names[short], x[short], None, nearest), names[short], nearest))

    ids, rows = [], []
    for row in queries.toLocalIterator():
        ids.append(row.vec_id)
        rows.append(row.embedding)
        if len(ids) == block:
            search_block(ids, rows)
            ids, rows = [], []
    if ids:
        search_block(ids, rows)
    if not results:
        return spark.createDataFrame([], schema)
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.select("query_id", "rank", "vec_id", "score")


def nearest_of_table(embeddings: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by ``every``, among all rows."""
    return search(embeddings, embeddings.filter(F.col("vec_id") % every == 0), nearest)
