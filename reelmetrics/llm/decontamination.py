"""Benchmark decontamination with a positional inverted index over the training text.

The index is a table of blocks of documents. A block lists its words (terms), how often each stands in it, and the
positions, term by term; documents lie one after another in a block's positions, with a gap between them. Blocks
are built where their documents are read, so no term's list is gathered from all documents, however common it is.

A phrase is looked up in every block from its rarest term in the whole corpus: the rarest term's list gives the
candidates, and the lists of the next rarest terms, moved by their offset in the phrase, are intersected with them
one after another. What is left after the last term is an occurrence. With ``slop``, each term may stand up to that
many places off (a proximity match).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.llm.shared import apart, written

WINDOW = 10
# Bytes of text in a block; bytes of benchmark text that are looked up at once; candidates that are held at once.
BLOCK, QUERIES, CANDIDATES = 1 << 19, 16 << 20, 1 << 19
# Bytes of words after A-Z are made small: digits, letters, and all beyond ASCII. The others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def built(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index: a row for each block of documents.

    doc_ids, text_hashes, n_words by document; terms and sizes by term; positions (term by term, as differences).
    A null text has no words. Every row is a document of its own, repeated or not.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = (
        f"doc_ids array<{id_type.simpleString()}>, text_hashes array<long>, n_words array<int>, "
        "terms array<string>, sizes array<int>, positions binary"
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[int] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            id_column, hash_column, text_column = batch.columns
            for doc_id, text_hash, text in zip(id_column, hash_column, text_column):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                hashes.append(text_hash.as_py())
                texts.append(words_of(text))
                held += len(text)
                if held >= block:
                    yield _block(ids, hashes, texts, id_column.type)
                    ids, hashes, texts, held = [], [], [], 0
        if ids:
            yield _block(ids, hashes, texts, id_column.type)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(build, schema)


def _block(ids: list, hashes: list[int], texts: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
    number: dict[bytes, int] = {}  # of each word, in the order of first use
    put = number.setdefault
    n_words = np.array([len(t) for t in texts], np.int64)
    term = np.fromiter((put(w, len(number)) for t in texts for w in t), np.int32, int(n_words.sum()))
    position = np.arange(len(term)) + np.repeat(np.arange(len(texts)), n_words)
    order = np.argsort(term, kind="stable")
    moves = np.diff(position[order], prepend=0).astype("<i4")
    sizes = np.bincount(term, minlength=len(number))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids], pa.list_(id_type)),
            pa.array([hashes], pa.list_(pa.int64())),
            pa.array([n_words.tolist()], pa.list_(pa.int32())),
            pa.array([[w.decode() for w in number]], pa.list_(pa.string())),
            pa.array([sizes.tolist()], pa.list_(pa.int32())),
            pa.array([moves.tobytes()], pa.binary()),
        ],
        names=["doc_ids", "text_hashes", "n_words", "terms", "sizes", "positions"],
    )


@dataclass(frozen=True)
class Phrases:
    """Phrases to look up at once. Rows of ``terms`` are padded with -1, rows of ``order`` list places by rarity."""

    vocabulary: list[str]
    terms: np.ndarray
    lengths: np.ndarray
    item: np.ndarray  # of each phrase, its place in item_ids
    item_ids: list
    order: np.ndarray

    @staticmethod
    def of_items(items: list[tuple[object, list[str]]], window: int) -> Phrases:
        """All windows of each item's words; an item of fewer words is one. Equal windows of an item are one."""
        ids: dict[object, int] = {}
        number: dict[str, int] = {}
        rows, lengths, owner = [], [], []
        for item_id, words in items:
            item = ids.setdefault(item_id, len(ids))
            numbers = [number.setdefault(w, len(number)) for w in words]
            k = min(window, len(words))
            for start in range(len(words) - k + 1 if k else 0):
                rows.append(numbers[start : start + k] + [-1] * (window - k))
                lengths.append(k)
                owner.append(item)
        terms = np.array(rows, np.int64).reshape(-1, window)
        keyed = np.column_stack([np.array(owner, np.int64), np.array(lengths, np.int64), terms])
        keyed = np.unique(keyed, axis=0)
        return Phrases(list(number), keyed[:, 2:], keyed[:, 1], keyed[:, 0], list(ids), np.zeros((0, window), np.int64))

    def by_rarity(self, counts: np.ndarray) -> Phrases:
        often = np.where(self.terms >= 0, np.append(counts, 0)[self.terms], np.iinfo(np.int64).max)
        return replace(self, order=np.argsort(often, axis=1, kind="stable"))


def occurrences(
    phrases: Phrases, terms: pa.Array, sizes: np.ndarray, positions: np.ndarray, slop: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start) of all occurrences in one block, some phrases at a time."""
    place = pc.index_in(pa.array(phrases.vocabulary, pa.string()), value_set=terms)
    local = np.append(pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
    here = local[phrases.terms]
    width = phrases.terms.shape[1]
    inside = phrases.terms >= 0
    live = np.flatnonzero(((here >= 0) | ~inside).all(1))
    if not len(live):
        return
    first = np.concatenate([[0], np.cumsum(sizes)])
    span = int(positions.max()) + width + 2 * slop + 2  # places before a block's first or after its last match no term
    keys = np.repeat(np.arange(len(sizes)), sizes) * span + positions
    rarest = here[live, phrases.order[live, 0]]
    n_candidates = sizes[rarest]
    groups = np.cumsum(n_candidates) // CANDIDATES
    for g in np.unique(groups):
        some, n = live[groups == g], n_candidates[groups == g]
        begin = first[here[some, phrases.order[some, 0]]]
        phrase = np.repeat(some, n)
        entry = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        start = positions[entry] - phrases.order[phrase, 0]
        for rank in range(1, width):
            offset = phrases.order[phrase, rank]
            used = rank < phrases.lengths[phrase]
            wanted = here[phrase, offset] * span + start + offset
            at = np.searchsorted(keys, wanted - slop)
            found = keys[np.minimum(at, len(keys) - 1)]
            near = (found >= wanted - slop) & (found <= wanted + slop) & (at < len(keys))
            kept = near | ~used
            phrase, start = phrase[kept], start[kept]
        yield phrase, start


def _matcher(phrases: Phrases, slop: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                column = lambda name: row.column(row.schema.get_field_index(name))  # noqa: E731, B023
                n_words = column("n_words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                positions = np.cumsum(np.frombuffer(column("positions")[0].as_py(), "<i4"), dtype=np.int64)
                base = np.cumsum(n_words + 1) - (n_words + 1)
                edges = np.zeros(int((n_words + 1).sum()) + phrases.terms.shape[1] + 2, np.int64)
                pairs = []
                if len(positions):
                    for phrase, start in occurrences(phrases, column("terms").flatten(), sizes, positions, slop):
                        doc = np.searchsorted(base, start, "right") - 1
                        size = phrases.lengths[phrase]
                        whole = (start >= base[doc]) & (start + size <= base[doc] + n_words[doc])
                        phrase, start, doc, size = phrase[whole], start[whole], doc[whole], size[whole]
                        np.add.at(edges, start, 1)
                        np.add.at(edges, start + size, -1)
                        pairs.append(np.unique(doc * len(phrases.item_ids) + phrases.item[phrase]))
                hit = np.cumsum(edges) > 0
                before = np.concatenate([[0], np.cumsum(hit)])
                old_hits = column("hits")[0].as_py()
                if old_hits is not None:
                    hit = hit | np.unpackbits(np.frombuffer(old_hits, np.uint8), count=len(hit)).astype(bool)
                    before = np.concatenate([[0], np.cumsum(hit)])
                items: list[set] = [set(x) for x in column("items")[0].as_py() or [()] * len(n_words)]
                for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
                    items[pair // len(phrases.item_ids)].add(phrases.item_ids[pair % len(phrases.item_ids)])
                n_hit = before[base + n_words] - before[base]
                values = {
                    "hits": pa.array([np.packbits(hit).tobytes()], pa.binary()),
                    "n_hit": pa.array([n_hit.tolist()], pa.list_(pa.int64())),
                    "items": pa.array([[sorted(x, key=lambda v: (v is None, v)) for x in items]], row.schema.field("items").type),
                }
                yield pa.RecordBatch.from_arrays([values.get(n, column(n)) for n in row.schema.names], names=row.schema.names)

    return match


def _term_counts(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """How often each word of the phrases stands in all documents."""
    spark = index.sparkSession
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(phrases.vocabulary)], "term string, number int")
    each = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("n"))
    found = each.join(F.broadcast(vocabulary), "term").groupBy("number").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(phrases.vocabulary), np.int64)
    for r in found:
        counts[r.number] = r.n
    return counts


def _query_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[object, list[str]]]]:
    items, held = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        words = [w.decode() for w in words_of(text)]
        if not words:
            continue
        items.append((item_id, words))
        held += len(text.encode())
        if held >= size:
            yield items
            items, held = [], 0
    if items:
        yield items


def looked_up(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, queries: int = QUERIES) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, n_hit, items (ids of the items found, in order).

    The benchmark is looked up in blocks of ``queries`` bytes of text (and the item that passes them), each over the
    whole index; what earlier blocks hit is kept as a bit for each word. Equal item ids are one item.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    found = index.select(
        "*",
        F.lit(None).cast("binary").alias("hits"),
        F.transform("n_words", lambda _: F.lit(0).cast("long")).alias("n_hit"),
        F.lit(None).cast(f"array<array<{item_type}>>").alias("items"),
    )
    first = True
    for items in _query_blocks(benchmark, queries):
        if not first:
            found = written(found, "decontamination")
        phrases = Phrases.of_items(items, window)
        phrases = phrases.by_rarity(_term_counts(index, phrases))
        found = found.mapInArrow(_matcher(phrases, slop), found.schema)
        first = False
    none = F.transform("n_words", lambda _: F.array().cast(f"array<{item_type}>"))
    zipped = F.arrays_zip("doc_ids", "text_hashes", "n_words", "n_hit", F.coalesce("items", none).alias("items"))
    each = found.select(F.explode(zipped).alias("d"))
    return each.select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.text_hashes").alias("text_hash"),
        F.col("d.n_words").cast("long").alias("n_words"),
        "d.n_hit",
        "d.items",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """The index of ``docs``, written, and the benchmark looked up in it."""
    return looked_up(written(built(docs), "postings"), benchmark, window, slop)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Null texts have no words, null and empty items no windows; a null item id counts as an item, but is not listed
    in the digest. Repeated rows give repeated rows.
    """
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(_listed(F.col("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _listed(items: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(items, lambda x: x.cast("string"))), ",")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a benchmark phrase, in their own columns. Equal texts share their fate."""
    rows = apart(docs)
    hit = contamination(rows, benchmark).filter("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return rows.join(hit, same, "left_anti").toDF(*docs.columns)
