"""Token counts by a compiled finite-state tokenizer.

The transducer of pieces.py reads a text and changes a running number of pieces. Every text is cut into chunks, short
ones into a single one, that are read apart. What a chunk does depends on the state it is entered in only up to the
first place where a segment begins, since there the state is always the start. So a chunk's map from entry state to
(exit state, pieces) is written down as the text before that place (read once the entry state is known), the pieces
of its whole segments, and the text after the last such place, which stands for the exit state. Maps compose, in any
grouping: neighbours are composed in pairs, level by level, as the up-sweep of a prefix scan does, so a text that has
no such place is copied once a level and held once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.llm.pieces import SPACE, Transducer, tools
from reelmetrics.llm.shared import appended, tokenizer_path

MODEL, LIMIT = "piece_bpe_32k.model", 4096
# Characters of a chunk; entries of the table of segments that were counted before, and characters of such a one.
CHUNK, SEEN, KEPT = 1 << 16, 800_000, 64
BORDER = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


@dataclass(frozen=True)
class ChunkMap:
    """``tail`` is None where no segment begins inside; then ``head`` is all of the chunk."""

    head: str
    pieces: int = 0
    tail: str | None = None


class Counter:
    """Counts of texts under one transducer; segments met before are looked up."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.seen: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of a normalised text."""
        total, get = 0, self.seen.get
        for segment in self.transducer.segment.findall(text):
            n = get(segment)
            if n is None:
                n = self.transducer.count(segment)
                if len(segment) <= KEPT:
                    if len(self.seen) >= SEEN:
                        self.seen.clear()
                    self.seen[segment] = n
            total += n
        return total

    def chunk_map(self, text: str) -> ChunkMap:
        """The map of a chunk of normalised text."""
        if not self.transducer.splits:
            return ChunkMap(text)
        first = BORDER.search(text)
        if first is None:
            return ChunkMap(text)
        a = first.start()  # a text's own first mark is no border, as nothing stands before it
        b = len(text)
        while True:  # the last place where a space follows another character
            b = text.rindex(SPACE, a, b)
            if text[b - 1] != SPACE:
                break
        return ChunkMap(text[:a], self.count(text[a:b]), text[b:])

    def compose(self, x: ChunkMap, y: ChunkMap) -> ChunkMap:
        """The map of two chunks that follow one another."""
        if x.tail is None:
            return ChunkMap(x.head + y.head, y.pieces, y.tail) if y.tail is not None else ChunkMap(x.head + y.head)
        between = x.tail + y.head
        if y.tail is None:
            inner = self.chunk_map(between)
            if inner.tail is None:
                return ChunkMap(x.head, x.pieces, between)
            return ChunkMap(x.head, x.pieces + self.count(inner.head) + inner.pieces, inner.tail)
        return ChunkMap(x.head, x.pieces + self.count(between) + y.pieces, y.tail)

    def total(self, whole: ChunkMap) -> int:
        """The pieces of a text from its start, given its map."""
        return self.count(whole.head) + whole.pieces + self.count(whole.tail or "")


@lru_cache(maxsize=2)
def counter_of(data: bytes) -> Counter:
    """A model's counter, kept for later tasks of a Python worker."""
    return Counter(tools(data)[2])


def composed(maps: list[ChunkMap], compose: Callable[[ChunkMap, ChunkMap], ChunkMap]) -> ChunkMap:
    """The map of all chunks together, by composing neighbours in a logarithmic number of sweeps."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else []
        maps = [compose(x, y) for x, y in zip(maps[::2], maps[1::2])] + odd
    return maps[0]


def count_documents(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; begin, end and other marks are not counted.

    A null text counts as empty (no bytes, no tokens). Texts are cut into chunks, which become maps; the maps of a
    text's chunks are composed where they meet. Repeated rows and null ids are rows of their own, and
    only doc_id and text are read.
    """
    with open(tokenizer_path(model), "rb") as file:
        data = file.read()
    normalizer = tools(data)[1]
    text = F.coalesce(F.col("text"), F.lit(""))
    # Cutting is safe where each character is normalised by itself; else texts stay whole.
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk).cast("int"))
    cuts = F.transform(places, lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)))
    parts = cuts if normalizer.plain else F.array("text")
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    rows = rows.select("row", "doc_id", n_bytes, F.posexplode(parts).alias("chunk", "part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer, counter = tools(data)[1], counter_of(data)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                heads, pieces, tails = [], [], []
                for part, place in zip(*(rows.column(i).to_pylist() for i in (4, 3))):
                    m = counter.chunk_map(normalizer.recorded(part)[0] if place == 0 else part.replace(" ", SPACE))
                    heads.append(m.head)
                    pieces.append(m.pieces)
                    tails.append(m.tail)
                found = {"head": pa.array(heads, pa.string()), "pieces": pa.array(pieces, pa.int64()), "tail": pa.array(tails, pa.string())}
                yield appended(rows, ["row", "doc_id", "n_bytes", "chunk"], found)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    maps = rows.mapInArrow(read, f"row long, doc_id {id_type}, n_bytes long, chunk int, head string, pieces long, tail string")
    # The chunks of one text meet, as maps; a text itself is one row already.
    texts = maps.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk", "head", "pieces", "tail"))).alias("maps"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(data)
        for batch in batches:
            totals = []
            for maps in batch.column(2).to_pylist():
                found = [ChunkMap(m["head"], m["pieces"], m["tail"]) for m in maps]
                totals.append(counter.total(composed(found, counter.compose)))
            yield appended(batch, ["doc_id", "n_bytes"], {"n_tokens": pa.array(totals, pa.int64())})

    counted = texts.select("doc_id", "n_bytes", "maps").mapInArrow(join, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
