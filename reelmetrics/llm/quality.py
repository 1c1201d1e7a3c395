"""Text quality by a sparse ensemble of rules over statistics of a text.

Statistics are column expressions: shares of kinds of characters, lengths, repetition of words and lines. A forest
of shallow trees over a sample of labelled texts proposes rules: each way from a root to an inner node or a leaf is a
conjunction of bounds on statistics. Rules, and the statistics themselves clipped at their tails, are the terms of
a logistic model with a lasso penalty, which leaves few of them; the penalty is the one of least loss on the part of
the sample that it was not fitted to. What is left is compiled into one column expression, so scoring texts is a
projection: no shuffle, no Python worker, one pass over each text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.llm.shared import apart, below_share, fold, written

# Bound of the fit: expected labelled texts.
SAMPLE_ROWS = 12_000
# Partitions of the sample.
PARTS = 8
TREES, DEPTH, SEED = 20, 4, 11
PENALTIES = (0.02, 0.005, 0.001)
# Numbers of the matrix of terms that one task takes in a pass of the fit, 32 MB.
TASK_NUMBERS = 4_000_000
# A rule must hold for at least this share of the sample, and fail for as many.
SUPPORT = 0.002
# Statistics are clipped at these quantiles where they are terms themselves.
TAILS = (0.025, 0.975)
LIMIT = 0.3
PREFIX = "_stat_"


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, doubles; a null text is an empty one, whose shares are 0."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    whole = F.greatest(n, F.lit(1))
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")

    rest = F.regexp_replace(text, r"\p{L}+", "")  # of a text without its letters, which are most of it

    def share(pattern: str, of: Column = text) -> Column:
        """The part of the text's characters that the pattern's matches take; ``of`` has all that can match."""
        return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))) / whole

    return {
        "log_chars": F.log1p(n),
        "letters": (n - F.length(rest)) / whole,
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+", rest),
        "stops": share("[.,;:]+", rest),
        "exclamations": share("[!?]+", rest),
        "symbols": share("[#$%&*+<=>@^_~/\\\\{}\\[\\]]+", rest),
        "bars": share("[|]+", rest),
        "word_length": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "repeats": share(r"\b(\p{L}++)\s++(?=\1\b)"),
        "line_length": F.log1p(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics, all of which must hold: low < statistic <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        """Parsed as one text: a fit builds hundreds of these, and each step of a column made in Python is a call into the JVM."""
        found = []
        for name, low, high in self.bounds:
            found += [f"{PREFIX}{name} > {low!r}D"] if low > -math.inf else []
            found += [f"{PREFIX}{name} <= {high!r}D"] if high < math.inf else []
        return F.expr(" AND ".join(found))

    def __str__(self) -> str:
        return " and ".join(f"{low:g} < {name} <= {high:g}" for name, low, high in self.bounds)


@dataclass(frozen=True)
class Model:
    """A logistic model: weights of rules, and of statistics clipped to a range."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()
    linear: tuple[tuple[str, float, float, float], ...] = ()  # statistic, least, most, weight

    def probability(self) -> Column:
        """The score as an expression over the columns of the statistics."""
        terms = [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        terms += [_clipped(name, low, high) * w for name, low, high, w in self.linear]
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))

    def firing(self) -> Column:
        """Numbers of the rules that hold, as ``rules`` lists them."""
        found = F.array(*(F.when(rule.column(), F.lit(i)) for i, (rule, _) in enumerate(self.rules)))
        return F.array_compact(found.cast("array<int>"))


def _clipped(name: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(PREFIX + name), F.lit(low)), F.lit(high))


def with_statistics(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(c.cast("double").alias(PREFIX + n) for n, c in statistics(F.col("text")).items()))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, part, statistics) of about ``rows`` distinct labelled texts, those whose hash is least.

    Only ids whose crc32 modulo 5 is not 0. A text's label is the commoner one of its ids, 1 if both are equally
    common; a null text is an empty one. Every fourth text is in part 1, which chooses the penalty.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", F.col(label).alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("_h")).join(known, "doc_id")
    each = hashed.groupBy("_h").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    chosen = each.filter(below_share(F.xxhash64("_h"), F.lit(rows / max(each.count(), 1))))
    found = texts.withColumn("_h", F.xxhash64("text")).join(F.broadcast(chosen), "_h")  # about ``rows`` hashes
    found = found.groupBy("_h").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    part = (F.pmod(F.col("_h"), F.lit(4)) == 0).cast("int").alias("part")
    found = with_statistics(found.select("_h", "label", part, "text")).drop("text")
    # So few rows make a few files, each of which costs every pass of the fit a task, also where a session deals keys wider.
    return found.repartition(PARTS, "_h").coalesce(PARTS).sortWithinPartitions("_h").drop("_h")


SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(described: str, names: list[str]) -> list[Rule]:
    """The ways from a root to each node below it, from a forest's description; bounds of one statistic are one."""
    rules: dict[Rule, None] = {}
    way: list[tuple[int, str, str, float]] = []
    for line in described.splitlines():
        found = SPLIT.match(line)
        if not found:
            continue
        depth = len(found[1])
        way = [step for step in way if step[0] < depth]
        way.append((depth, names[int(found[3])], found[4], float(found[5])))
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, at in way:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        rules[Rule(tuple((n, *bounds[n]) for n in sorted(bounds)))] = None
    return list(rules)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """The model of label 1 against 0. Without texts of both labels it is the share of label 1, one of each added."""
    sample = written(labelled(docs, labels, label, rows), "quality-sample")
    ones, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    prior = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return Model(prior)
    names = [c.removeprefix(PREFIX) for c in sample.columns if c.startswith(PREFIX)]
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird",
        minInfoGain=1e-4, maxBins=64, seed=SEED,
    ).fit(VectorAssembler(inputCols=[PREFIX + c for c in names], outputCol="features").transform(sample))
    rules = tree_paths(forest.toDebugString, names)
    if rules:
        held = sample.agg(*(F.avg(r.column().cast("double")) for r in rules)).first()
        rules = [r for r, share in zip(rules, held) if SUPPORT <= share <= 1 - SUPPORT]
    tails = sample.approxQuantile([PREFIX + c for c in names], list(TAILS), 0.001)
    linear = [(c, low, high) for c, (low, high) in zip(names, tails) if low < high]
    terms = [r.column().cast("double") for r in rules] + [_clipped(*x) for x in linear]
    if not terms:
        return Model(prior)
    vector = array_to_vector(F.array(*terms)).alias("features")
    matrix = written(sample.select("label", "part", vector), "quality-terms")
    # Hundreds of passes go over it. Between several partitions each is a shuffle more, and each stage costs the driver megabytes.
    matrix = matrix.coalesce(math.ceil(n * len(terms) / TASK_NUMBERS))
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, maxIter=60, tol=1e-5)
    chosen = _penalty(lasso, matrix)
    model = lasso.setRegParam(chosen).fit(matrix)
    weights = model.coefficients.toArray().tolist()
    of_rules, of_linear = weights[: len(rules)], weights[len(rules) :]
    return Model(
        float(model.intercept),
        tuple((r, w) for r, w in zip(rules, of_rules) if w),
        tuple((*x, w) for x, w in zip(linear, of_linear) if w),
    )


def _penalty(lasso: LogisticRegression, matrix: DataFrame) -> float:
    """The penalty of least loss on part 1 when fitted to part 0; the first if a part lacks a label."""
    parts = {(r.part, r.label) for r in matrix.select("part", "label").distinct().collect()}
    if len(parts) < 4:
        return PENALTIES[0]

    def loss(penalty: float) -> float:
        model = lasso.copy({lasso.regParam: penalty}).fit(matrix.filter("part = 0"))
        likely = vector_to_array("probability")[1]
        right = F.when(F.col("label") == 1, likely).otherwise(1 - likely)
        scored = model.transform(matrix.filter("part = 1"))
        return scored.agg(F.avg(-F.log(F.greatest(right, F.lit(1e-9))))).first()[0]

    # A fit is over a hundred small jobs, one after another, which leave most cores idle: the penalties are fitted side by side.
    with ThreadPool(len(PENALTIES)) as pool:
        losses = dict(zip(PENALTIES, pool.map(inheritable_thread_target(matrix.sparkSession)(loss), PENALTIES)))
    return min(losses, key=losses.get)


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """The rows with the probability of label 1, and ``rules``, the numbers of the model's rules that hold.

    Columns of these names are replaced; all others stay, whatever they are called. Equal texts score alike.
    """
    kept = [c for c in docs.columns if c not in (name, "rules")]
    rows = apart(docs.select(*kept))
    found = with_statistics(rows).select(*rows.columns, model.probability(), model.firing() if model.rules else F.array().cast("array<int>"))
    return found.toDF(*kept, name, "rules")


def score_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted and n_rules (of the rules that hold) of every document.

    Null texts score as empty ones, rows with null ids are not held out, repeated rows give repeated rows.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
        F.size("rules").alias("n_rules"),
    )
