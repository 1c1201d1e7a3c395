"""Hard negatives by maximum inner product over an R-tree packed by sort-tile-recursive.

Vectors become whole numbers. Rows are cut into slabs by their first component (``repartitionByRange``; equal
components are told apart by a row number, so any number of equal vectors spreads), and each task packs its slab:
it is sorted by one coordinate after another and cut into tiles, down to leaves. Leaves, the inner boxes above them
and the nodes above those have minimum bounding boxes; a node with all that is below it is one row of a written
table, and a slab's box is that of its nodes.

A box and an anchor give an interval of inner products: for each coordinate the lesser and the greater product with
the two sides of the box, summed. A search visits boxes from a queue, highest upper end first. It leaves out boxes
whose interval misses every window of scores, and ends when the highest upper end is strictly below the lowest score
kept of each full list. Anchors meet the nodes of the slabs that their intervals allow, block by block, and lists of
different nodes are ranked together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.shared import written

# Rows of a leaf; leaves of an inner box; rows of a node and of a slab, and slabs at most.
LEAF, INNER, NODE, SLABS = 128, 8, 4096, 1024
# Bytes of vectors in a node and in a pack; anchors of a block; blocks whose lowest scores a task remembers.
NODE_BYTES, PACK_BYTES, ANCHORS, REMEMBERED = 2 << 20, 32 << 20, 512, 256
LEAST, MOST = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, n, v) of the rows that take part: floor(scale * x) of each component, and their number n.

    Left out are rows with a null label, a null vector, or a null or non-finite component. Raises where components
    are so large that a score of vectors of that length may pass a long. ``row`` tells repeated rows apart.
    """
    wide = F.transform("embedding", lambda x: x.cast("double") * scale)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    most = F.least(F.lit(2.0**31 - 1), F.sqrt(F.lit(2.0**63) / F.greatest(F.size("x"), F.lit(1))) - 2)
    large = F.exists("x", lambda x: F.abs(x) > most)
    message = F.lit("components are too large for scores in a long")
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wide.alias("x")
    ).select(
        "row", "vec_id", "label", F.size("x").alias("n"),
        F.when(large, F.raise_error(message)).otherwise(F.transform("x", lambda x: F.floor(x).cast("int"))).alias("v"),
    )


def str_order(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The rows of each leaf, in packing order.

    A tile of p leaves is sorted by its next coordinate (those of greatest spread first) and cut into slabs of whole
    leaves: p ** (1 / k) of them, where k coordinates are left, but at least two.
    """
    out: list[np.ndarray] = []
    coordinates = np.argsort(-(x.max(0) - x.min(0)), kind="stable") if x.size else np.zeros(0, int)

    def cut(rows: np.ndarray, level: int) -> None:
        p = -(-len(rows) // leaf)
        if p <= 1:
            out.append(rows)
            return
        left = max(len(coordinates) - level, 1)
        slabs = max(2, round(p ** (1 / left)))
        each = -(-p // slabs) * leaf
        if len(coordinates):
            rows = rows[np.argsort(x[rows, coordinates[level % len(coordinates)]], kind="stable")]
        for at in range(0, len(rows), each):
            cut(rows[at : at + each], level + 1)

    cut(np.arange(len(x)), 0)
    return out


def boxes(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each coordinate, for the runs of rows that begin at ``starts``."""
    if not x.shape[1]:
        return (np.zeros((len(starts), 0), x.dtype),) * 2
    return np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)


def exact(*parts: np.ndarray) -> type:
    """The type in which inner products of such vectors are exact: doubles, which multiply faster, where they can."""
    size = max((int(np.abs(p).max(initial=0)) for p in parts), default=0)
    return np.float64 if parts[0].shape[-1] * size * size < 2**53 else np.int64


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, box]: least and greatest inner product that a vector in the box can have."""
    kind = exact(anchors, low, high)
    up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return up @ low + down @ high, up @ high + down @ low


class Node:
    """A node's rows in packing order, with the boxes of its leaves and of runs of leaves."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, rows: np.ndarray, x: np.ndarray, leaves: np.ndarray):
        self.ids, self.known, self.labels, self.rows, self.x = ids, known, labels, rows, x
        self.ends = np.cumsum(leaves)
        self.starts = self.ends - leaves
        self.leaf_boxes = boxes(x, self.starts)
        self.inner = np.arange(0, len(leaves), INNER)
        self.inner_boxes = boxes(x, self.starts[self.inner])

    @staticmethod
    def of(row: dict) -> Node:
        ids = row["ids"].values
        labels, rows, leaves = (row[c].values.to_numpy(zero_copy_only=False) for c in ("labels", "rows", "leaves"))
        x = np.frombuffer(row["x"].as_py(), "<i4").reshape(len(rows), -1)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return Node(ids.fill_null(0).to_numpy(zero_copy_only=False), known, labels, rows, x, leaves)

    def batch(self, slab: int, number: int) -> pa.RecordBatch:
        low, high = boxes(self.x, np.zeros(1, int))
        columns = {
            "slab": pa.array([slab], pa.int32()),
            "node": pa.array([number], pa.int64()),
            "n": pa.array([self.x.shape[1]], pa.int32()),
            "low": pa.array([low[0].tolist()], pa.list_(pa.int32())),
            "high": pa.array([high[0].tolist()], pa.list_(pa.int32())),
            "ids": pa.array([pa.array(self.ids, mask=~self.known)], pa.list_(pa.int64())),
            "labels": pa.array([self.labels], pa.list_(pa.int64())),
            "rows": pa.array([self.rows], pa.list_(pa.int64())),
            "leaves": pa.array([(self.ends - self.starts).tolist()], pa.list_(pa.int32())),
            "x": pa.array([self.x.astype("<i4").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


NODES = "slab int, node long, n int, low array<int>, high array<int>, ids array<long>, labels array<long>, rows array<long>, leaves array<int>, x binary"


def packed(vectors: DataFrame, slabs: int, leaf: int = LEAF) -> DataFrame:
    """The nodes of an R-tree over ``whole_vectors``, a row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId()
        number = slab << 32
        for n, held in _runs(batches):
            ids, labels, rows = (pa.concat_arrays([b.column(c) for b in held]) for c in ("vec_id", "label", "row"))
            x = np.concatenate([b.column("v").flatten().to_numpy() for b in held]).reshape(len(rows), n)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, labels, rows = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in (ids, labels, rows))
            order = str_order(x, leaf)
            each = max(1, min(NODE // leaf, NODE_BYTES // (4 * max(n, 1) * leaf)))
            for at in range(0, len(order), each):
                leaves = order[at : at + each]
                take = np.concatenate(leaves)
                yield Node(ids[take], known[take], labels[take], rows[take], x[take], np.array([len(k) for k in leaves])).batch(slab, number)
                number += 1

    ranged = vectors.repartitionByRange(slabs, "n", F.get("v", F.lit(0)), "row").sortWithinPartitions("n")
    return ranged.mapInArrow(pack, NODES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(n, rows of that length), as many at once as PACK_BYTES allow; rows come sorted by n."""
    held: list[pa.RecordBatch] = []
    size, of = 0, -1
    for batch in batches:
        lengths = batch.column("n").to_numpy()
        for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lengths)) + 1):
            if not len(part):
                continue
            n = int(lengths[part[0]])
            if held and (n != of or size + 4 * n * len(part) > PACK_BYTES):
                yield of, held
                held, size = [], 0
            held.append(batch.slice(part[0], len(part)))
            size, of = size + 4 * n * len(part), n
    if held:
        yield of, held


@dataclass
class Lists:
    """The best rows of one anchor in each of its windows, and how many boxes the search opened."""

    scores: list[np.ndarray]
    places: list[np.ndarray]
    lowest: list[int]
    opened: int = 0


def search(
    node: Node, anchor: np.ndarray, row: int, label: int, same: bool, windows: list[tuple[int, int, int]], most: int,
    inner: tuple[np.ndarray, np.ndarray], leaf: tuple[np.ndarray, np.ndarray],
) -> Lists:
    """The best ``most`` rows of a node for one anchor in each window (low, high, known lowest score).

    Rows of the anchor's label if ``same``, else of others; its own row never. ``inner`` and ``leaf`` are the
    anchor's intervals over the node's boxes. Lists hold all rows that tie with their last by score and id.
    """
    lows, highs = [w[0] for w in windows], [w[1] for w in windows]
    found = Lists([np.zeros(0, np.int64) for _ in windows], [np.zeros(0, np.int64) for _ in windows], [max(w[0], w[2]) for w in windows])
    kind = exact(node.x, anchor)
    vector = anchor.astype(kind)
    queue = [(-int(u), 0, i) for i, u in enumerate(inner[1])]
    heapq.heapify(queue)
    while queue:
        upper, level, box = heapq.heappop(queue)
        if -upper < min(found.lowest):  # strictly: a row with the lowest score may still have a smaller id
            break
        least = int((leaf if level else inner)[0][box])
        open_to = [w for w in range(len(windows)) if least <= highs[w] and -upper >= found.lowest[w]]
        if not open_to:
            continue
        found.opened += 1
        if not level:
            first = node.inner[box]
            for k in range(first, min(first + INNER, len(node.starts))):
                heapq.heappush(queue, (-int(leaf[1][k]), 1, k))
            continue
        a, b = node.starts[box], node.ends[box]
        scores = (node.x[a:b].astype(kind) @ vector).astype(np.int64)
        fits = ((node.labels[a:b] == label) == same) & (node.rows[a:b] != row)
        places, scores = a + np.flatnonzero(fits), scores[fits]
        for w in open_to:
            good = (scores >= found.lowest[w]) & (scores <= highs[w])
            if not good.any():
                continue
            s, p = np.concatenate([found.scores[w], scores[good]]), np.concatenate([found.places[w], places[good]])
            order = np.lexsort((node.rows[p], node.ids[p], ~node.known[p], -s))[:most]
            found.scores[w], found.places[w] = s[order], p[order]
            if len(order) == most:
                found.lowest[w] = max(found.lowest[w], int(s[order[-1]]))
    assert all(low <= x for low, x in zip(lows, found.lowest))
    return found


FOUND = "anchor long, window int, score long, vec_id long, row long"


def anchors_of(tree: DataFrame, every: int, most: int) -> DataFrame:
    """The rows whose vec_id is divisible by ``every``, with the lowest of the best ``most`` same-label scores in their own node."""
    schema = "row long, vec_id long, label long, n int, x binary, bound long"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _records(batches):
            node = Node.of(record)
            mine = np.flatnonzero(node.known & (node.ids % every == 0))
            bounds = []
            inner, leaf = intervals(node.x[mine], *node.inner_boxes), intervals(node.x[mine], *node.leaf_boxes)
            for i, k in enumerate(mine):
                got = search(node, node.x[k], node.rows[k], node.labels[k], True, [(LEAST, MOST, LEAST)], most, (inner[0][i], inner[1][i]), (leaf[0][i], leaf[1][i]))
                bounds.append(got.lowest[0])
            columns = [node.rows[mine], node.ids[mine], node.labels[mine], np.full(len(mine), node.x.shape[1], np.int32)]
            vectors = pa.array([node.x[k].astype("<i4").tobytes() for k in mine], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), vectors, pa.array(bounds, pa.int64())], names=[c.split()[0] for c in schema.split(", ")])

    return tree.mapInArrow(home, schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def _slab_boxes(tree: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: the slabs, and the sides of their boxes. At most SLABS boxes of a length."""
    sides = tree.select("slab", "n", F.posexplode_outer(F.arrays_zip("low", "high")).alias("place", "side"))
    each = sides.groupBy("slab", "n", "place").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
    listed = each.groupBy("slab", "n").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("sides"))
    found: dict[int, list] = {}
    for r in listed.collect():
        sides = [(s.low, s.high) for s in r.sides if s.place is not None]
        found.setdefault(r.n, []).append((r.slab, [x for x, _ in sides], [x for _, x in sides]))
    return {
        n: (np.array([r[0] for r in rows]), *(np.array([r[k] for r in rows], np.int64).reshape(len(rows), n) for k in (1, 2)))
        for n, rows in found.items()
    }


def _blocks(anchors: DataFrame, slabs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Anchors with windows, packed: a row for each block and slab in which one of them may find something."""
    schema = "block long, n int, slabs array<int>, anchors array<struct<row:long,label:long,lows:array<long>,highs:array<long>,bounds:array<long>>>, x binary"
    kind = pa.list_(pa.struct([("row", pa.int64()), ("label", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("lows", "highs", "bounds"))]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[dict]] = {}

        def block(n: int) -> pa.RecordBatch:
            nonlocal number
            rows = held.pop(n)
            number += 1
            x = np.frombuffer(b"".join(r["x"] for r in rows), "<i4").reshape(len(rows), n)
            names, low, high = slabs[n]
            least, greatest = intervals(x, low, high)
            lowest = np.array([min(max(a, b) for a, b in zip(r["lows"], r["bounds"])) for r in rows])
            highest = np.array([max(r["highs"]) for r in rows])
            some = ((greatest >= lowest[:, None]) & (least <= highest[:, None])).any(0)
            packed = [{c: r[c] for c in ("row", "label", "lows", "highs", "bounds")} for r in rows]
            columns = [pa.array([number - 1]), pa.array([n], pa.int32()), pa.array([names[some].tolist()], pa.list_(pa.int32())), pa.array([packed], kind), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "n", "slabs", "anchors", "x"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["lows"] and r["n"] in slabs:
                    held.setdefault(r["n"], []).append(r)
                    if len(held[r["n"]]) == ANCHORS:
                        yield block(r["n"])
        for n in list(held):
            yield block(n)

    return anchors.select("row", "label", "n", "x", "lows", "highs", "bounds").mapInArrow(pack, schema)


def visited(anchors: DataFrame, tree: DataFrame, slabs: dict, same: bool, most: int) -> DataFrame:
    """(anchor, window, rank, vec_id, score): the best ``most`` rows in each window of each anchor.

    ``anchors`` have row, label, n, x, and lists lows, highs, bounds: for each window its ends and a score that is
    known to be reached ``most`` times (or the least long).
    """
    blocks = written(_blocks(anchors, slabs), "anchor-blocks")
    kept = ["slab", "n", "ids", "labels", "rows", "leaves", "x"]
    # A block comes once for each of its slabs, of which no estimate of its size knows: a broadcast would gather all of them in the driver.
    at_slabs = blocks.withColumn("slab", F.explode("slabs")).drop("slabs").withColumnRenamed("x", "ax")
    pairs = at_slabs.hint("merge").join(tree.select(*kept), ["slab", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[int, dict] = {}  # of blocks met before in this task
        for record in _records(batches):
            node = Node.of(record)
            block, rows = record["block"].as_py(), record["anchors"].as_py()
            x = np.frombuffer(record["ax"].as_py(), "<i4").reshape(len(rows), -1)
            inner, leaf = intervals(x, *node.inner_boxes), intervals(x, *node.leaf_boxes)
            known = lowest.setdefault(block, {})
            out: list[tuple] = []
            for i, r in enumerate(rows):
                bounds = known.get(i, r["bounds"])
                windows = list(zip(r["lows"], r["highs"], bounds))
                got = search(node, x[i], r["row"], r["label"], same, windows, most, (inner[0][i], inner[1][i]), (leaf[0][i], leaf[1][i]))
                known[i] = got.lowest
                for w, (s, p) in enumerate(zip(got.scores, got.places)):
                    if len(p):
                        ids = pa.array(node.ids[p], mask=~node.known[p])
                        out.append((np.full(len(p), r["row"]), np.full(len(p), w, np.int32), s, ids, node.rows[p]))
            if len(lowest) > REMEMBERED:
                lowest.pop(next(iter(lowest)))
            if out:
                a, w, s, ids, p = zip(*out)
                columns = [pa.array(np.concatenate(c)) for c in (a, w, s)] + [pa.concat_arrays(ids), pa.array(np.concatenate(p))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    found = pairs.select("block", "anchors", "ax", *kept[2:]).mapInArrow(meet, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("anchor", "window", "rank", "vec_id", "score")


def mined(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` have vec_id, embedding and label. Anchors are the rows whose vec_id is divisible by ``every``; an
    anchor's positives are its best ``positives`` other rows of its label, and each positive's negatives the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score
    (none where the positive's score is below 0). Higher scores come first, then smaller ids, null ids last. Only
    vectors of an anchor's own length meet it. Repeated rows are rows of their own. Empty without anchors.
    """
    rows = written(whole_vectors(vectors, scale), "vectors")
    slabs = min(max(-(-rows.count() // NODE), 1), SLABS)
    tree = written(packed(rows, slabs), "rtree")
    boxes_of = _slab_boxes(tree)
    anchors = written(anchors_of(tree, every, positives), "anchors")
    long = lambda *x: F.array(*(F.lit(v).cast("long") for v in x))
    whole = anchors.select("*", long(LEAST).alias("lows"), long(MOST).alias("highs"), F.array("bound").alias("bounds"))
    nearest = visited(whole, tree, boxes_of, True, positives)
    nearest = written(nearest.select("anchor", F.struct("rank", "vec_id", "score").alias("p")), "positives")
    listed = nearest.groupBy("anchor").agg(F.sort_array(F.collect_list("p")).alias("positives"))  # a few each
    windowed = anchors.join(listed, anchors.row == listed.anchor).select(
        anchors["*"],
        "positives",
        F.transform("positives", lambda p: F.ceil(_hundredths(p["score"], low)).cast("long")).alias("lows"),
        F.transform("positives", lambda p: F.floor(_hundredths(p["score"], high)).cast("long")).alias("highs"),
        F.transform("positives", lambda p: F.lit(LEAST).cast("long")).alias("bounds"),
    )
    windowed = written(windowed, "windows")
    hard = visited(windowed, tree, boxes_of, False, negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    each = windowed.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("window", "p"))
    return hard.join(each.hint("merge"), ["anchor", "window"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score"
    )


def _hundredths(score: Column, times: int) -> Column:
    """times * score / 100 as a decimal, exact for any long."""
    return score.cast("decimal(20,0)") * F.lit(times).cast("decimal(9,0)") * F.lit("0.01").cast("decimal(3,2)")
