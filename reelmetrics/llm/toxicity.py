"""Toxic passages by maximum-scoring segments, and a document score by extreme-value statistics.

Tokens are words. A word's score is the log-odds of its share in toxic texts against the share of all words there,
with Dirichlet priors: a word's counts start from those of its stem (its first letters), a stem's from the class
shares. Words that are not significantly more frequent in toxic texts cost a small drift, so that a stretch of
clean text scores below zero. One scan over a text's scores finds all maximal segments (each has the highest sum
among its extensions, and they do not overlap).

Under clean text the best segment of n words follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)).
lambda is the positive root of sum p exp(lambda s) = 1 over the clean words' scores; K comes from clean texts that
took no part in the word counts. The normalised scores of a text's r best segments add up, and the sum's tail
probability (for the r that makes it least) gives the text's statistic, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from reelmetrics.llm.shared import apart, appended, below_share, fold, written

# Bounds of the fit: expected labelled texts of each class, and entries of the lexicon.
SAMPLE_ROWS, LEXICON = 6000, 50_000
STEM = 5
PRIOR, LEAST_Z, DRIFT = 2.0, 3.0, 0.25
# Passages are reported up to this expected number of clean ones in a text of the same length.
MOST_EXPECTED = 0.05
EULER = 0.5772156649015329
RIDGE = 0.01
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    scale: float = 1.0  # lambda
    density: float = 1.0  # K
    slope: float = 0.0
    shift: float = -4.0


@dataclass(frozen=True)
class Segment:
    first: int  # token numbers
    last: int
    score: float


def hits(words: list[str], lexicon: Lexicon) -> list[tuple[int, float]]:
    """Place and score of the words whose score is above zero; all others cost DRIFT."""
    known, stems = lexicon.words, lexicon.stems
    found = []
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None and len(w) > STEM:
            s = stems.get(w[:STEM])
        if s is not None and s > 0:
            found.append((i, s))
    return found


def segments(found: list[tuple[int, float]]) -> list[Segment]:
    """All maximal scoring segments of a text, from its positive tokens; linear in their number.

    Between two of them every token costs DRIFT. A candidate keeps the running sum before it (low) and after it
    (high) and the nearest earlier candidate whose low is smaller; each candidate is merged or passed over once.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    smaller: list[int] = []
    total, at = 0.0, 0
    for i, s in found:
        before = total - DRIFT * (i - at)
        total, at = before + s, i + 1
        begin, bottom = i, before
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= bottom:
                j = smaller[j]
            if j < 0 or high[j] >= total:
                break
            begin, bottom = first[j], low[j]
            for kept in (first, last, low, high, smaller):
                del kept[j:]
        first.append(begin)
        last.append(i)
        low.append(bottom)
        high.append(total)
        smaller.append(j)
    return [Segment(a, b, h - x) for a, b, x, h in zip(first, last, low, high)]


def surprise(scores: list[float], n: int, scale: float, density: float) -> float:
    """-ln of the least tail probability of the sums of the best 1, 2, ... segments of n words; 0 at the least."""
    base = math.log(max(density * n, 1e-12))
    best, total, r = 0.0, 0.0, 0
    for s in sorted(scores, reverse=True):
        x = scale * s - base
        if x <= 0:
            break
        total, r = total + x, r + 1
        if r == 1:
            p = -math.expm1(-math.exp(-total))
            best = -math.log(p) if p > 0 else total
        else:
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - 2 * math.log(r))
    return best


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(toxic, part, text): about ``rows`` distinct labelled texts a class, those whose hash is least.

    Only ids whose crc32 modulo 5 is not 0, and texts with a word, of any length: a stretch might miss the passage
    that the label is for. A class's texts are counted among these. An id with several labels, and a text with
    several ids, is toxic if one is. Every fourth text is in part 1, which calibrates, the others in part 0, which
    is counted.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    texts = docs.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", "text", F.xxhash64("text").alias("_h"))
    # One text for each id and one id for each text: copies would count a passage many times.
    each = texts.groupBy("doc_id").agg(F.min("_h").alias("_h")).join(known, "doc_id")
    each = each.groupBy("_h").agg(F.max("toxic").alias("toxic"))
    shares = each.groupBy("toxic").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("_share"))
    chosen = each.join(F.broadcast(shares), "toxic").filter(below_share(F.col("_h"), F.col("_share"))).drop("_share")
    texts = texts.join(F.broadcast(chosen), "_h")  # two classes of about ``rows`` hashes
    texts = texts.groupBy("_h").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    return texts.select("toxic", (F.pmod(F.col("_h"), F.lit(4)) == 0).cast("int").alias("part"), "text")


def counted(sample: DataFrame) -> DataFrame:
    """(kind, token, toxic, n): texts of each class that hold a word or a stem; the empty token counts the texts."""
    schema = "kind string, token string, toxic boolean, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                own = set(words)
                found.update(("word", w, toxic) for w in own)
                found.update(("stem", s, toxic) for s in {w[:STEM] for w in own if len(w) > STEM})
                found["all", "", toxic] += len(own)
        kinds, tokens, classes = zip(*found) if found else ((), (), ())
        columns = [pa.array(kinds, pa.string()), pa.array(tokens, pa.string()), pa.array(classes, pa.bool_())]
        columns.append(pa.array(list(found.values()), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "token", "toxic", "n"])

    each = sample.filter("part = 0").select("toxic", "text").mapInArrow(count, schema)
    return each.groupBy("kind", "token").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("n0"),
    )


def scored_tokens(counts: DataFrame, size: int = LEXICON) -> tuple[Lexicon, float]:
    """Words and stems significantly more frequent in toxic texts, at most ``size`` of each, and lambda."""
    totals = counts.filter("kind = 'all'").agg(F.sum("n1"), F.sum("n0")).first()
    n1, n0 = (int(x or 0) for x in totals)
    if not n1 or not n0:
        return Lexicon({}, {}), 1.0
    share = n1 / (n1 + n0)
    n = F.col("n1") + F.col("n0")
    z = (F.col("n1") - n * share) / F.sqrt(n * share * (1 - share))
    likely = counts.filter((F.col("kind") != "all") & (n >= 2) & (z >= LEAST_Z)).withColumn("z", z)
    kept = []
    for kind in ("stem", "word"):
        kept += likely.filter(F.col("kind") == kind).orderBy(F.desc("z"), "token").limit(size).collect()
    stems = {r.token: (r.n1 + PRIOR * share) / (r.n1 + r.n0 + PRIOR) for r in kept if r.kind == "stem"}
    known = {r.token: (r.n1 + PRIOR * stems.get(r.token[:STEM], share)) / (r.n1 + r.n0 + PRIOR) for r in kept if r.kind == "word"}
    logit = lambda p: math.log(p / (1 - p)) - math.log(share / (1 - share))
    lexicon = Lexicon({w: logit(p) for w, p in known.items()}, {w: logit(p) for w, p in stems.items()})
    # Shares of the clean words; stems stand for words that are not listed and are left to the drift here.
    rows = [(lexicon.words[r.token], (r.n0 + 0.5) / (n0 + 1)) for r in kept if r.kind == "word"]
    s = np.array([x for x, _ in rows] + [-DRIFT])
    p = np.array([x for _, x in rows] + [max(1 - sum(x for _, x in rows), 1e-6)])
    if not rows or (s * p).sum() >= 0:
        return lexicon, 1.0
    a, b = 0.0, 1.0
    while (p * np.exp(b * s)).sum() < 1:
        b *= 2
    for _ in range(60):
        middle = (a + b) / 2
        a, b = (middle, b) if (p * np.exp(middle * s)).sum() < 1 else (a, middle)
    return lexicon, b


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's steps with a small ridge."""
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        bend = (design * (p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(2)
        step = np.linalg.solve(bend, design.T @ (y - p) - RIDGE * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon and its calibration, fitted on the bounded sample of labelled documents."""
    sample = written(labelled(docs, labels), "toxic-sample")
    lexicon, scale = scored_tokens(counted(sample))
    if not lexicon.words and not lexicon.stems:
        return lexicon

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text.lower())
                rows.append((len(words), [s.score for s in segments(hits(words, lexicon))]))
            n, scores = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))
            yield appended(batch, ["toxic"], {"n": n, "scores": scores})

    held = sample.filter("part = 1").select("toxic", "text").mapInArrow(measure, "toxic boolean, n long, scores array<double>").collect()
    clean = [scale * max(r.scores, default=0.0) - math.log(max(r.n, 1)) for r in held if not r.toxic]
    density = math.exp(min(max(sum(clean) / len(clean) - EULER, -20), 5)) if clean else 1.0
    x = np.array([_statistic(surprise(r.scores, r.n, scale, density)) for r in held])
    y = np.array([float(r.toxic) for r in held])
    if len(set(y.tolist())) < 2:
        return Lexicon(lexicon.words, lexicon.stems, scale, density)
    slope, shift = _logistic(x, y)
    return Lexicon(lexicon.words, lexicon.stems, scale, density, max(slope, 0.0), shift)


def _statistic(x: float) -> float:
    return math.log1p(x)


PASSAGES = pa.list_(
    pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
)
ADDED = StructType([
    StructField("toxicity", DoubleType()),
    StructField("passages", ArrayType(StructType([
        StructField("begin", LongType()), StructField("end", LongType()),
        StructField("score", DoubleType()), StructField("expected", DoubleType()),
    ]))),
])


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text") -> DataFrame:
    """The rows with ``toxicity`` (0 to 1) and ``passages``; columns of these names are replaced.

    Passages are all maximal segments with at most MOST_EXPECTED expected in clean text of that length, in order,
    as code point offsets of the text. A null or empty text has none and the score of a text without toxic words.
    Equal texts score alike, whatever their other columns hold.
    """
    kept = [c for c in docs.columns if c not in ADDED.names]
    schema = StructType([docs.schema[c] for c in kept] + ADDED.fields)
    def of(text: str | None, m: Lexicon) -> tuple[float, list]:
        text = text or ""
        words = WORD.findall(text.lower())
        found = segments(hits(words, m))
        x = surprise([s.score for s in found], len(words), m.scale, m.density)
        value = 1 / (1 + math.exp(-max(min(m.slope * _statistic(x) + m.shift, 30), -30)))
        passages = []
        for s in found:
            expected = m.density * len(words) * math.exp(-m.scale * s.score)
            if expected <= MOST_EXPECTED:
                passages.append((s, expected))
        if not passages:
            return value, []
        places = [w.span() for w in WORD.finditer(text.lower())]
        return value, [{"begin": places[s.first][0], "end": places[s.last][1], "score": s.score, "expected": e} for s, e in passages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [of(t, m) for t in part.column(at).to_pylist()]
                scores, passages = pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], PASSAGES)
                yield appended(part, kept, {"toxicity": scores, "passages": passages})

    return docs.select(*kept).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of passages of every document."""
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below the limit, in their own columns."""
    rows = apart(docs)
    kept = score(rows, train(rows, labels)).filter(F.col("toxicity") < limit)
    return kept.select(*rows.columns).toDF(*docs.columns)
