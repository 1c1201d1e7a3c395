"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a variable-order tree of contexts counts which byte followed which preceding bytes. A byte seen
in a context costs -log2(count / (n + q)) bits there, n being the context's total and q its distinct bytes; another
byte costs an escape, q / (n + q), and its probability in the next shorter context, renormalised over the bytes
not seen in the longer one (exclusion). The shortest context of all gives every byte the same probability. The
probabilities of a context therefore sum to one, and the code length of a text is exact.

The statistics are frozen before scoring, so the cost of a byte depends on the bytes just before it only, and a
whole batch of texts is scored with array lookups: ``order`` steps down a shared tree of contexts, then one row of
costs, a column per language. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from reelmetrics.llm.shared import apart, appended, below_share, fold

# Bounds of the sample that the trees are fitted on: expected texts of a language, and UTF-8 bytes taken of each.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 32_768
ORDER, CONTEXTS = 4, 16_384
# Bytes that are scored at once.
BLOCK = 1 << 18
UNKNOWN = "und"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Trees:
    """Frozen statistics of all languages. Symbol 0 is a text's start and bytes not in the sample."""

    languages: list[str]
    order: int
    symbol: np.ndarray  # of each byte
    n_symbols: int
    child: np.ndarray  # [context * n_symbols + earlier symbol]; context 0 is none, context 1 the empty one
    cost: np.ndarray  # [context * n_symbols + symbol, language] in bits; the last row is zero


def fitted(texts: dict[str, list[bytes]], order: int = ORDER, contexts: int = CONTEXTS) -> Trees:
    """Trees of each language's texts, over the ``contexts`` most frequent contexts of up to ``order`` bytes."""
    languages = sorted(texts)
    small = np.arange(256)
    small[65:91] += 32  # A-Z count as a-z
    seen = np.unique(small[np.frombuffer(b"".join(b"".join(texts[x]) for x in languages), np.uint8)])
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[65:91] = symbol[97:123]
    s = len(seen) + 1
    # Each language's symbols, each text behind ``order`` symbols 0 (its start), and the places of its bytes.
    streams = []
    for x in languages:
        raw = symbol[np.frombuffer(b"".join(texts[x]), np.uint8)].astype(np.int16)
        size = np.array([len(t) for t in texts[x]], np.int64)
        at = np.arange(len(raw), dtype=np.int32)
        at += (order * (1 + np.repeat(np.arange(len(size)), size))).astype(np.int32)
        padded = np.zeros(len(raw) + order * len(size), np.int16)
        padded[at] = raw
        streams.append((padded, at))

    def codes(stream: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """Of each byte, the number that the k symbols before it make, the nearest in the lowest place."""
        padded, at = stream
        code = np.zeros(len(at), np.int64)
        for j in range(k, 0, -1):
            code *= s
            code += padded[at - j]
        return code

    def counted(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of k bytes and how often they occur, a language's bytes at a time."""
        found, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for stream in streams:
            own, n = np.unique(codes(stream, k), return_counts=True)
            found, place = np.unique(np.concatenate([found, own]), return_inverse=True)
            count = np.bincount(place, np.concatenate([count, n]), len(found)).astype(np.int64)
        return found, count

    levels = [counted(k) for k in range(1, order + 1)]
    counts = np.concatenate([c for _, c in levels]) if levels else np.zeros(0, int)
    if len(counts) > contexts - 2:  # a context is at least as frequent as any longer one, so its parent is kept too
        least = np.sort(counts)[-(contexts - 2)] + 1
    else:
        least = 1
    kept = [np.zeros(1, np.int64)] + [found[c >= least] for found, c in levels]
    first = 1 + np.cumsum([0] + [len(k) for k in kept])
    total = int(first[-1])
    child = np.zeros(total * s, np.int32)
    parents = np.zeros(total, np.int64)
    for k in range(1, order + 1):
        ids = first[k] + np.arange(len(kept[k]))
        parent = first[k - 1] + np.searchsorted(kept[k - 1], kept[k] % s ** (k - 1))
        child[parent * s + kept[k] // s ** (k - 1)] = ids
        parents[first[k] : first[k + 1]] = parent
    # A class of several bytes shares its symbol's probability evenly.
    width = np.bincount(symbol, minlength=s).astype(float)
    cost = np.zeros((total * s + 1, len(languages)), np.float32)
    for x, stream in enumerate(streams):
        symbols = stream[0][stream[1]].astype(np.int64)
        count = np.zeros((total, s), np.float32)
        for k in range(order + 1):
            if not len(kept[k]):
                continue
            code = codes(stream, k)
            at = np.minimum(np.searchsorted(kept[k], code), len(kept[k]) - 1)
            hit = kept[k][at] == code
            seen_here = np.bincount(at[hit] * s + symbols[hit], minlength=len(kept[k]) * s)
            count[first[k] : first[k + 1]] = seen_here.reshape(-1, s)
        p = np.zeros((total, s))
        uniform = width / 256
        for k in range(order + 1):
            rows = slice(first[k], first[k + 1])
            below = p[parents[rows]] if k else np.broadcast_to(uniform, (1, s))
            c = count[rows]
            n, unseen = c.sum(1, keepdims=True), c == 0
            q = (~unseen).sum(1, keepdims=True)
            rest = np.where(unseen, below, 0)
            left = rest.sum(1, keepdims=True)
            # Where every byte was seen there is nothing to escape to.
            escape = np.where(n == 0, 1.0, np.where(left > 0, q / np.maximum(n + q, 1), 0.0))
            scale = np.where(left > 0, n + q, n)
            p[rows] = np.where(unseen, escape * rest / np.where(left > 0, left, 1), c / np.maximum(scale, 1))
        bits = -np.log2(np.maximum(p[1:] / np.where(width > 0, width, 1), 1e-300))
        cost[s:-1, x] = bits.reshape(-1)
    return Trees(languages, order, symbol, s, child, cost)


def _pieces(lengths: np.ndarray, block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (text, from, to), each of ``block`` bytes at most; longer texts are cut."""
    piece, size = [], 0
    for i, n in enumerate(lengths.tolist()):
        for a in range(0, n, block):
            b = min(a + block, n)
            if size + b - a > block and piece:
                yield piece
                piece, size = [], 0
            piece.append((i, a, b))
            size += b - a
    if piece:
        yield piece


def code_lengths(trees: Trees, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Bits of every text under every language; text i is data[offsets[i]:offsets[i + 1]]."""
    d, s = trees.order, trees.n_symbols
    out = np.zeros((len(offsets) - 1, len(trees.languages)))
    for pieces in _pieces(np.diff(offsets), block):
        text = np.array([i for i, _, _ in pieces])
        size = np.array([b - a for _, a, b in pieces])
        ends = np.cumsum(size + d)
        starts = ends - size
        padded = np.zeros(ends[-1], np.int32)
        real = np.ones(ends[-1], bool)
        real[(starts[:, None] - 1 - np.arange(d)).ravel()] = False
        # Pieces of a block follow one another in the data; only the first may be the rest of a text.
        (i, a, _), (j, _, b) = pieces[0], pieces[-1]
        padded[real] = trees.symbol[data[offsets[i] + a : offsets[j] + b]]
        before = data[offsets[i] + max(0, a - d) : offsets[i] + a]
        padded[d - len(before) : d] = trees.symbol[before]
        current = np.ones(len(padded), np.int32)
        context = current
        for k in range(1, d + 1):
            earlier = np.zeros(len(padded), np.int32)
            earlier[k:] = padded[:-k]
            current = trees.child[current * s + earlier]
            context = np.where(current > 0, current, context)
        row = np.where(real, context * s + padded, len(trees.cost) - 1)
        cost = trees.cost[row]
        np.add.at(out, text, np.add.reduceat(cost, starts, axis=0, dtype=np.float64))
    return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text): about ``rows`` ids of each language, those whose hash is least, with their texts' bytes.

    Only rows with a language, a text with a letter, and an id whose crc32 modulo 3 is not 1; a language's ids are
    counted among these. Of a text over ``size`` bytes a stretch of that size is taken, at a hashed place.
    """
    usable = F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (fold(F.col("doc_id"), 3) != 1)
    learn = docs.filter(usable).select("lang", "text", F.xxhash64("doc_id").alias("_h"))
    shares = learn.groupBy("lang").agg((F.lit(float(rows)) / F.approx_count_distinct("_h")).alias("_share"))
    n = F.octet_length("text")
    at = F.pmod(F.xxhash64("_h", n), F.greatest(n - size + 1, F.lit(1))).cast("int") + 1
    stretch = F.substring(F.col("text").cast("binary"), at, F.lit(size))
    return (
        learn.join(F.broadcast(shares), "lang")  # a row for each language
        .filter(below_share(F.col("_h"), F.col("_share")))
        .groupBy("lang", "_h")
        .agg(F.max(stretch).alias("text"))
        .select("lang", "text")
    )


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Trees:
    """Trees fitted on the bounded sample, whose rows are all that reaches the driver."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in sample(docs, rows, size).orderBy("lang", "text").collect():
        whole = bytes(text).decode(errors="ignore").encode()  # without the characters that a stretch cuts
        texts.setdefault(lang, []).append(whole)
    return fitted(texts)


def _utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


ADDED = StructType([
    StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("bits_per_byte", DoubleType())
])


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows with lang_pred, lang_score (0 to 1) and bits_per_byte; columns of these names are replaced.

    The score is the probability of the language, all being equally likely before. A null text, or one without a
    letter, is ``und`` with score 0, as is every text where no language was learned. Equal texts score alike.
    """
    kept = [c for c in docs.columns if c not in ADDED.names]
    schema = StructType([docs.schema[c] for c in kept] + ADDED.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trees
        for batch in batches:
            data, offsets = _utf8(batch.column(batch.schema.get_field_index("text")))
            letters = batch.column(batch.schema.get_field_index("_letters")).to_numpy(zero_copy_only=False).astype(bool)
            n = np.maximum(np.diff(offsets), 1)
            if t.languages:
                bits = code_lengths(t, data, offsets)
                best = bits.argmin(1)
                low = bits[np.arange(len(bits)), best]
                odds = np.exp2(np.clip(low[:, None] - bits, -1000, 0))
                probability = 1 / odds.sum(1)
            else:
                best, low, probability = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n))
                letters = np.zeros(len(n), bool)
            names = [t.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            found = (pa.array(names, pa.string()), pa.array(np.where(letters, probability, 0.0)), pa.array(low / n))
            yield appended(batch, kept, dict(zip(ADDED.names, found)))

    letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    return docs.select(*kept, letters.alias("_letters")).mapInArrow(score, schema)


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    trees = train(docs)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs.select("doc_id", "text"), trees).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte"
    )


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows whose language is certain enough, in their own columns. Texts without letters are rejected."""
    rows = apart(docs)
    found = identify(rows, train(rows))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_score))
    return kept.select(*rows.columns).toDF(*docs.columns)
