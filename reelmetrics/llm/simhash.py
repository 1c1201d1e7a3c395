"""Near-duplicate documents by SimHash, found with a Gray-order hierarchical index.

A fingerprint takes the majority of each bit over the hashes of a text's word shingles. Fingerprints that differ in
few bits link their documents, and linked documents form groups.

Equal fingerprints are first made one. The rest meet below upper nodes that fix a masked bit pattern: of four
blocks of 16 bits, two fingerprints at distance 3 or less agree in one, and of four blocks of 12 in the bits left,
again in one. So each fingerprint stands below 16 nodes of 28 fixed bits, and two that link share a node. Below a
node they are sorted by Gray rank, in which neighbours tend to share bits, and runs of them are factored into a
tree: a tree node holds the bits all its members share and its parent does not. A search adds up the differences
in those bits on its way down, and drops a whole subtree once they exceed the limit; at a leaf the sum is the
distance itself.

A node with very many members is cut into chunks and searched chunk against chunk, so no task holds more than two
chunks of a node, and none of its pairs is left out. Tasks report spanning links only, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reelmetrics.llm.components import components
from reelmetrics.llm.shared import apart, appended, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
BITS = 64
# Shingles whose bits are spread out at once.
SPREAD = 1 << 16
# Members of a node's chunk; children of a tree node; queries searched at once.
CHUNK, FANOUT, SLICE = 4096, 16, 256


# Fingerprints.


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Of every text, as unsigned numbers. Words are split at ASCII white space; A-Z count as a-z."""
    out = np.zeros(len(texts), np.uint64)
    pending: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(shingle, len(words))
        starts = np.concatenate([[0], ends[: len(words) - k] + 1])
        hashed = xxhash.xxh64_intdigest
        spans = zip(starts.tolist(), ends[k - 1 :].tolist())
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))
        pending.append((i, hashes))
        held += len(hashes)
        if held >= SPREAD:
            _majorities(pending, out)
            pending, held = [], 0
    _majorities(pending, out)
    return out


def _majorities(pending: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
    if not pending:
        return
    at = np.array([i for i, _ in pending])
    size = np.array([len(h) for _, h in pending])
    hashes = np.concatenate([h for _, h in pending])
    text = np.repeat(np.arange(len(at)), size)
    counts = np.zeros((len(at), BITS), np.int64)
    for a in range(0, len(hashes), SPREAD):
        part = hashes[a : a + SPREAD]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(text[a : a + SPREAD], prepend=-1))
        counts[text[a : a + SPREAD][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    major = counts * 2 > size[:, None]
    out[at] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows with ``fingerprint`` (as a signed long); a column of that name is replaced."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("fingerprint", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = fingerprints(part.column(text).to_pylist(), shingle)
                yield appended(part, kept, {"fingerprint": pa.array(found.view(np.int64))})

    return docs.select(*kept).mapInArrow(run, schema)


# The index.


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of every number in the sequence of Gray codes."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Tree:
    """Fingerprints in Gray order; level 0 are they, a node of level k + 1 has FANOUT nodes of level k."""

    def __init__(self, members: np.ndarray):
        self.order = np.argsort(gray_rank(members), kind="stable")
        x = members[self.order]
        masks, patterns = [np.full(len(x), ~np.uint64(0))], [x]
        while len(patterns[-1]) > FANOUT:
            first = np.arange(0, len(patterns[-1]), FANOUT)
            pattern, mask = patterns[-1], masks[-1]
            same = pattern[np.repeat(first, np.diff(np.append(first, len(pattern))))] ^ pattern
            shared = np.bitwise_and.reduceat(mask & ~same, first)
            masks.append(shared)
            patterns.append(pattern[first] & shared)
        # What a parent holds already is taken out of its children.
        self.own = [m & ~np.repeat(masks[k + 1], FANOUT)[: len(m)] if k + 1 < len(masks) else m for k, m in enumerate(masks)]
        self.patterns = patterns

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a query, number of a member) at most ``limit`` bits apart."""
        top = len(self.patterns) - 1
        query = np.repeat(np.arange(len(queries)), len(self.patterns[top]))
        node = np.tile(np.arange(len(self.patterns[top])), len(queries))
        apart = np.zeros(len(node), np.uint8)
        for level in range(top, -1, -1):
            apart = apart + np.bitwise_count((queries[query] ^ self.patterns[level][node]) & self.own[level][node])
            near = apart <= limit
            query, node, apart = query[near], node[near], apart[near]
            if level:
                n = len(self.patterns[level - 1])
                query, apart = np.repeat(query, FANOUT), np.repeat(apart, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < n
                query, node, apart = query[inside], node[inside], apart[inside]
        return query, self.order[node]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes (each node's least known companion) after the links a-b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        least = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not (label[label] == label).all():
            label = label[label]


def spanning(left: np.ndarray, right: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is at most ``limit`` bits apart: among ``left``, or between left and right."""
    members = left if right is None else np.concatenate([left, right])
    tree, label = Tree(left), np.arange(len(members))
    queries, shift = (left, 0) if right is None else (right, len(left))
    for a in range(0, len(queries), SLICE):
        query, found = tree.search(queries[a : a + SLICE], limit)
        label = merged(label, query + a + shift, found)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return members[moved], members[label[moved]]


def _node(fp: Column, block: int, sub: int) -> Column:
    """The 28 fixed bits of one of the 16 upper nodes; its number is added above them."""
    high = F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))
    # The 48 other bits, drawn together.
    low = fp.bitwiseAND(F.lit((1 << (16 * block)) - 1))
    rest = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * block), 16), 16 * block).bitwiseOR(low)
    twelve = F.shiftrightunsigned(rest, 12 * sub).bitwiseAND(F.lit(0xFFF))
    return F.shiftleft(F.shiftleft(high, 12).bitwiseOR(twelve), 4).bitwiseOR(F.lit(block * 4 + sub).cast("long"))


PLACED = StructType([StructField("a", LongType()), StructField("b", LongType())])


def links(distinct: DataFrame, limit: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of ``distinct`` at most ``limit`` bits apart."""
    if not 0 <= limit <= 3:
        raise ValueError("the upper nodes are made for distances up to 3")
    fp = F.col("fingerprint")
    nodes = distinct.select(fp, F.explode(F.array(*(_node(fp, i, j) for i in range(4) for j in range(4)))).alias("node"))
    large = nodes.groupBy("node").count().filter(F.col("count") > chunk).select("node", F.ceil(F.col("count") / chunk).alias("chunks"))
    nodes = nodes.join(large, "node", "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks").cast("int") - 1),
        lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi"), own.alias("own")),
    )
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own")))
    parts = nodes.select("fingerprint", "node", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(others)).alias("p"))
    parts = parts.select("node", "p.lo", "p.hi", (F.col("p.own") != F.col("p.lo")).cast("int").alias("side"), "fingerprint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node and chunks; a group that may go on in the next batch waits for it."""
        waiting: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            rows = rows if waiting is None else np.concatenate([waiting, rows])
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            cut = int(change[-1]) if len(change) else 0
            yield from found(rows[:cut], change[:-1])
            waiting = rows[cut:]
        if waiting is not None:
            yield from found(waiting, np.zeros(0, np.int64))

    def found(rows: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``change`` has the first row of every group but the first."""
        if not len(rows):
            return
        start = np.concatenate([[0], change])
        size = np.diff(np.append(start, len(rows)))
        fps = rows[:, 4].copy().view(np.uint64)
        a, b = [], []
        pairs = start[size == 2]
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= limit
        same_side = (rows[pairs, 3] == rows[pairs + 1, 3]) == (rows[pairs, 1] == rows[pairs, 2])
        pairs = pairs[near & same_side]
        a.append(fps[pairs])
        b.append(fps[pairs + 1])
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            members, side = fps[s : s + n], rows[s : s + n, 3]
            if rows[s, 1] == rows[s, 2]:
                x, y = spanning(members, None, limit)
            elif side.any() and not side.all():
                x, y = spanning(members[side == 0], members[side == 1], limit)
            else:
                continue
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    group = ["node", "lo", "hi"]
    return parts.repartition(*group).sortWithinPartitions(*group).mapInArrow(search, PLACED)


def roots(fingerprinted: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """(fingerprint, root): every distinct fingerprint with the one that stands for its group."""
    distinct = written(fingerprinted.select("fingerprint").distinct(), "fingerprints")
    joined = components(links(distinct, limit)).withColumnRenamed("node", "fingerprint")
    return distinct.join(joined, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def group_documents(docs: DataFrame, shingle: int = SHINGLE, limit: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of the group.

    Null, empty and blank texts have fingerprint zero and are one group. Rows of null ids are members like others
    and never name a group unless all its ids are null; repeated rows give repeated rows.
    """
    marked = written(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"), "simhash")
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(roots(marked, limit), "fingerprint")
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = classes.join(heads, "root").select("fingerprint", "component_id")
    return marked.join(of_class, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, limit: int = DISTANCE) -> DataFrame:
    """One row of each group, in the columns of ``docs``: that of the least doc_id, null ids last.

    The rows are written once with a number of their own, so that of repeated rows exactly one stays.
    """
    rows = apart(docs)
    marked = written(with_fingerprint(rows.withColumn("_row", F.monotonically_increasing_id()), shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    classes = marked.groupBy("fingerprint").agg(F.min(order).alias("least")).join(roots(marked, limit), "fingerprint")
    first = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_row"))
    return marked.join(first, "_row", "left_semi").select(*rows.columns).toDF(*docs.columns)
