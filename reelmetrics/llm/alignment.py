"""Tokens of two tokenizers aligned over the bytes of a text, and how often their ids are linked in the corpus.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, the text has a shared cut; the
tokens between two neighbouring shared cuts are a group, and each first token of a group is linked to each second
one. Shared cuts are found by dividing: a common end near the middle of an interval is located by bisecting one
list of ends for an end of the other in turn, first to the right of the middle, then to its left. It cuts the
interval, the halves are treated alike, and what was passed over on the way has no shared cut and is not looked at
again. An interval without one is a leaf: one group. All intervals of a block of texts are divided together, level
by level, so a long text needs no deep recursion.

A block's texts are kept as one row with the distinct links of the block, so that corpus-wide counts and their way
back shuffle a link once for each block that has it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.llm.shared import tokenizer_path, written

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text in a block; a text that passes the bound ends its block. Links held at once while a group is read.
BLOCK, LINKS = 1 << 20, 1 << 20
# A link is first id * ID + second id.
ID = 1 << 24


def _right(a: np.ndarray, b: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval of places in ``a``, the first place from ``at`` to below ``high`` whose end is in ``b``; or -1."""
    found = np.full(len(at), -1)
    live = np.flatnonzero(at < high)
    at = at.copy()
    while len(live):
        ends = a[at[live]]
        other = b[np.searchsorted(b, ends)]
        same = other == ends
        found[live[same]] = at[live[same]]
        live, other = live[~same], other[~same]
        at[live] = np.searchsorted(a, other)
        live = live[at[live] < high[live]]
    return found


def _left(a: np.ndarray, b: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """As ``_right``, downwards from ``at`` to ``low``."""
    found = np.full(len(at), -1)
    live = np.flatnonzero(at >= low)
    at = at.copy()
    while len(live):
        ends = a[at[live]]
        place = np.searchsorted(b, ends, "right") - 1
        live, ends, place = live[place >= 0], ends[place >= 0], place[place >= 0]
        other = b[place]
        same = other == ends
        found[live[same]] = at[live[same]]
        live, other = live[~same], other[~same]
        at[live] = np.searchsorted(a, other, "right") - 1
        live = live[at[live] >= low[live]]
    return found


def shared_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in ``a`` whose ends are in ``b`` too, within the intervals from ``low`` to below ``high``.

    Both lists of ends rise, and ``b`` ends no earlier than ``a``.
    """
    cuts = [np.zeros(0, np.int64)]
    while len(low):
        middle = (low + high) // 2
        right = _right(a, b, middle, high)
        none = right < 0
        left = np.full(len(low), -1)
        left[none] = _left(a, b, middle[none] - 1, low[none])
        cut = np.maximum(left, right)
        cuts.append(cut[cut >= 0])
        # Left of a cut right of the middle, nothing from the middle on is shared; right of one left of it, nothing is.
        lows = np.concatenate([low[~none], low[left >= 0], right[~none] + 1])
        highs = np.concatenate([middle[~none], left[left >= 0], high[~none]])
        low, high = lows[lows < highs], highs[lows < highs]
    return np.sort(np.concatenate(cuts))


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# Fixed: how a byte-level vocabulary cuts a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The faster library fails on a run of spaces of some hundred thousand; texts with such runs go to the other one.
LONG_SPACE = re.compile(r"\s{4096}")


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the ids as text followed by each of the three marks.

    The byte-level file is read by two libraries that give the same ids (a test compares them for every character):
    the one for its format, and a faster one where ids are the order of merges, as they are in this file.
    """

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_buffer(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        alphabet = _byte_alphabet()
        spec = json.loads(first)
        words, merges = spec["model"]["vocab"], spec["model"]["merges"]
        joined = (m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges)
        cutting = spec["pre_tokenizer"]
        plain = cutting["type"] == "ByteLevel" and cutting["use_regex"] and not cutting["add_prefix_space"] and not spec["normalizer"]
        self.fast = None
        if plain and all(words.get(m) == 256 + i for i, m in enumerate(joined)):
            ranks = {bytes(alphabet[c] for c in name): i for name, i in words.items() if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        vocabulary = self.first.get_vocab()
        names = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            names[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        second = self.second
        pieces = [second.id_to_piece(i) for i in range(second.get_piece_size())]
        other = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = names, other
        self.sizes = tuple(np.array([len(x) for x in found]) for found in self.bytes)
        n = max(len(names), len(other))
        self.marked = np.array([[f"{i}{mark}" for i in range(n)] for mark in ",|;"], object)

    def first_ids(self, text: str) -> list[int]:
        if self.fast is not None and not LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        return self.first.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers; none where the bytes of either differ from a space and the text."""
        a = [self.first_ids(" " + t) for t in texts]
        b = self.second.encode(texts, num_threads=1)
        first, second = self.bytes
        found = []
        for text, x, y in zip(texts, a, b):
            raw = b" " + text.encode()
            same = text and b"".join([first[i] for i in x]) == raw and b"".join([second[i] for i in y]) == raw
            found.append((x, y) if same else ([], []))
        return found


@lru_cache(maxsize=1)
def tokenizers_of(first: bytes, second: bytes) -> Tokenizers:
    """Kept for later tasks of a Python worker."""
    return Tokenizers(first, second)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of ``sizes``, one after another."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes), sizes)


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """(document, link, times) of groups that lie one after another, some links more than once.

    Most groups are small and written out. Of a large one each first id meets each second id once, with the product
    of how often they stand there, so equal tokens are not paired one by one.
    """
    small = n_a * n_b <= 64
    start_a, start_b = _starts(n_a), _starts(n_b)
    one = np.flatnonzero(small)
    token = np.repeat(start_a[one], n_a[one]) + _within(n_a[one])  # of the first kind, in small groups
    of = np.repeat(one, n_a[one])
    times = n_b[of]
    second = np.repeat(start_b[of], times) + _within(times)
    yield np.repeat(doc[of], times), np.repeat(a[token], times) * ID + b[second], np.ones(len(second), np.int64)
    for g in np.flatnonzero(~small):
        x, of_x = np.unique(a[start_a[g] : start_a[g] + n_a[g]], return_counts=True)
        y, of_y = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        step = max(LINKS // len(y), 1)
        for at in range(0, len(x), step):
            link = (x[at : at + step, None] * ID + y).ravel()
            yield np.full(len(link), doc[g]), link, np.outer(of_x[at : at + step], of_y).ravel()


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, link) in order, each once, with its times."""
    doc, link, times = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((link, doc))
    doc, link, times = doc[order], link[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(link) != 0)])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], link[first], np.add.reduceat(times, first) if len(first) else times


class Block:
    """Some texts, their tokens, groups and links."""

    def __init__(self, texts: list[str], tools: Tokenizers):
        found = tools.encode(texts)
        self.n_a, self.n_b = (np.array([len(x[side]) for x in found], np.int64) for side in (0, 1))
        a, b = (np.array([i for x in found for i in x[side]], np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(tools.sizes[0][a]), np.cumsum(tools.sizes[1][b])
        some = np.flatnonzero(self.n_a)
        low = _starts(self.n_a)[some]
        last = low + self.n_a[some] - 1  # texts end in both
        inner = low < last
        cuts = np.sort(np.concatenate([shared_cuts(ends_a, ends_b, low[inner], last[inner]), last]))
        n_a = np.diff(cuts, prepend=-1)
        n_b = np.diff(np.searchsorted(ends_b, ends_a[cuts]), prepend=-1)
        doc = np.repeat(np.arange(len(texts)), self.n_a)[cuts]  # of each group
        self.n_groups = np.bincount(doc, minlength=len(texts))
        self.n_links = np.bincount(doc, n_a * n_b, len(texts)).astype(np.int64)
        self.hashes = self._hashes(a, b, n_a, n_b, tools)
        parts: list[tuple] = []
        held = 0
        for part in _links(a, b, n_a, n_b, doc):
            parts.append(part)
            held += len(part[0])
            if held > 8 * LINKS:
                parts = [_summed(parts)]
                held = 0
        self.doc, self.link, self.times = _summed(parts)

    def _hashes(self, a, b, n_a, n_b, tools: Tokenizers) -> list[str]:
        """Of every text, the SHA-256 of its groups as text; '' without tokens."""
        group = np.concatenate([np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        kind = 2 * group[order] + side[order]
        last = np.concatenate([np.diff(kind) != 0, [True]]) if len(kind) else np.zeros(0, bool)
        marks = np.where(last, 1 + side[order], 0)
        words = tools.marked[marks, np.concatenate([a, b])[order]].tolist()
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join(words[at : at + n])[:-1].encode()).hexdigest() if n else "")
            at += n
        return out

    def row(self, number: int, ids: list, id_type: pa.DataType) -> pa.RecordBatch:
        links, place = np.unique(self.link, return_inverse=True)
        columns = {
            "block": pa.array([number], pa.int64()),
            "doc_ids": pa.array([ids], pa.list_(id_type)),
            **{n: pa.array([getattr(self, n).tolist()], pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")},
            "hashes": pa.array([self.hashes], pa.list_(pa.string())),
            "links": pa.array([links], pa.list_(pa.int64())),
            "n_docs": pa.array([np.bincount(place, minlength=len(links))], pa.list_(pa.int64())),
            "sizes": pa.array([np.bincount(self.doc, minlength=len(ids))], pa.list_(pa.int64())),
            "places": pa.array([place.astype("<u4").tobytes()], pa.binary()),
            "times": pa.array([self.times.astype("<i8").tobytes() if self.times.max(initial=1) > 255 else self.times.astype("u1").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


BLOCKS = (
    "block long, doc_ids array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "hashes array<string>, links array<long>, n_docs array<long>, sizes array<long>, places binary, times binary"
)


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """A row for each block of texts: its documents' figures, its links and how many documents have each.

    ``places`` and ``times`` tell, document after document (``sizes``), which of the block's links it has and how often.
    """
    files = []
    for name in (first, second):
        with open(tokenizer_path(name), "rb") as file:
            files.append(file.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers_of(*files)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        held, kind = 0, None
        for batch in batches:
            id_column, text_column = batch.columns
            kind = id_column.type
            for doc_id, text in zip(id_column, text_column):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= block:
                    yield Block(texts, tools).row(number, ids, kind)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield Block(texts, tools).row(number, ids, kind)

    return docs.select("doc_id", "text").mapInArrow(build, BLOCKS.format(id_type))


def link_counts(blocks: DataFrame) -> DataFrame:
    """(link, n, best): in how many documents a link stands, and whether no link of its first id stands in more."""
    each = blocks.select(F.explode(F.arrays_zip("links", "n_docs")).alias("l"))
    counts = each.groupBy(F.col("l.links").alias("link")).agg(F.sum("l.n_docs").alias("n"))
    # The links of one id are at most as many as the other tokenizer has ids.
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("link") / ID)))
    return counts.select("link", "n", (F.col("n") == most).alias("best"))


def align_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and ''.
    Repeated rows and null ids are documents of their own, and count as such. Only doc_id and text are read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = written(aligned(docs, first, second, block), "aligned")
    each = blocks.select("block", F.posexplode("links").alias("place", "link"))
    found = each.join(link_counts(blocks), "link").groupBy("block").agg(
        F.collect_list(F.struct("place", "n", "best")).alias("found")  # a block's links at most
    )
    kept = ["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "hashes", "sizes", "places", "times"]
    schema = (
        f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                place, n, best = (x.to_numpy(zero_copy_only=False) for x in row["found"].values.flatten()) if row["found"].is_valid else (np.zeros(0, int),) * 3
                order = np.argsort(place)
                n, best = n[order].astype(np.int64), best[order].astype(np.int64)
                sizes = row["sizes"].values.to_numpy(zero_copy_only=False)
                places = np.frombuffer(row["places"].as_py(), "<u4")
                raw = row["times"].as_py()
                times = np.frombuffer(raw, "u1" if len(raw) == len(places) else "<i8").astype(np.int64)
                ends = np.cumsum(sizes)

                def by_document(values: np.ndarray) -> pa.Array:
                    total = np.concatenate([[0], np.cumsum(values)])
                    return pa.array(total[ends] - total[ends - sizes], pa.int64())

                columns = [row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                columns += [by_document(times * best[places]), by_document(times * n[places]), row["hashes"].values]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return blocks.select(*kept).join(found, "block", "left").drop("block").mapInArrow(sums, schema)
