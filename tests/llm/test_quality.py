from __future__ import annotations

import math
import re
import random
import threading
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from reelmetrics.llm import quality

WORDS = "the of and river stone carries quiet morning light over old houses while people walk slowly home".split()


def corpus(n=240, seed=3):
    """(doc_id, text, label): prose, and junk of three kinds; a few copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(30, 90))
        kind = i % 6
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words)
        elif kind == 2:
            text = " ".join([rng.choice(words)] * len(words))
        else:
            text = " ".join(words).capitalize() + "."
        rows.append((i, text, int(kind > 2)))
    return rows


@pytest.fixture
def frames(llm, documents):
    def make(rows, extra=""):
        labels = llm.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
        return documents([r[:2] for r in rows], extra), labels

    return make


def brute_statistics(text):
    n = len(text)
    share = lambda keep: sum(map(keep, text)) / max(n, 1)
    words, lines = re.split(r"\s+", text), text.split("\n")
    return {
        "log_chars": math.log1p(n),
        "letters": share(str.isalpha),
        "capitals": share(str.isupper),
        "digits": share(str.isdigit),
        "stops": share(lambda c: c in ".,;:"),
        "exclamations": share(lambda c: c in "!?"),
        "symbols": share(lambda c: c in "#$%&*+<=>@^_~/\\{}[]"),
        "bars": share(lambda c: c == "|"),
        "word_length": n / len(words),
        "distinct_words": len(set(words)) / len(words),
        "line_length": math.log1p(n / len(lines)),
        "distinct_lines": len(set(lines)) / len(lines),
    }


def test_statistics_equal_their_definition(documents):
    texts = ["", "One two two, THREE!\nfour|4 $x", "a\na\na", "x" * 3000, *(t for _, t, _ in corpus(12))]
    got = quality.with_statistics(documents(list(enumerate(texts)))).collect()
    for r in got:
        for name, value in brute_statistics(r.text).items():
            assert r[quality.PREFIX + name] == pytest.approx(value), (r.text, name)
    repeats = quality.with_statistics(documents([(1, "so so so good"), (2, None)])).orderBy("doc_id").collect()
    assert repeats[0][quality.PREFIX + "repeats"] == pytest.approx(6 / 13)
    assert repeats[1][quality.PREFIX + "log_chars"] == 0


def test_paths_of_a_described_tree():
    told = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      If (feature 0 <= 0.25)
       Predict: 1.0
      Else (feature 0 > 0.25)
       Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    found = [r.bounds for r in quality.tree_paths(told, ["a", "b"])]
    low, high = -math.inf, math.inf
    assert found == [
        (("a", low, 0.5),), (("a", low, 0.5), ("b", low, 2.0)), (("a", low, 0.5), ("b", 2.0, high)),
        (("a", low, 0.25), ("b", 2.0, high)), (("a", 0.25, 0.5), ("b", 2.0, high)), (("a", 0.5, high),),
    ]


def test_held_out_texts_and_the_compiled_expression(frames):
    docs, labels = frames(corpus())
    model = quality.fit(docs, labels)
    assert model.rules and len(model.rules) < 300
    rows = quality.with_statistics(quality.score(docs, model)).collect()
    for r in rows:  # the expression against the model read in plain Python
        stat = {n: r[quality.PREFIX + n] for n in quality.statistics(F.col("text"))}
        fires = [all(low < stat[n] <= high for n, low, high in rule.bounds) for rule, _ in model.rules]
        total = model.intercept + sum(w for f, (_, w) in zip(fires, model.rules) if f)
        total += sum(w * min(max(stat[n], low), high) for n, low, high, w in model.linear)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-total)))
        assert r.rules == [i for i, f in enumerate(fires) if f]
    known = {i: q for i, _, q in corpus()}
    got = quality.score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(known) and len(held) > 20
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_nulls_ties_repeated_rows_and_clashing_columns(frames):
    rows = corpus(120) + [(500, None, 0), (501, "", None), (7, "again", 1), (7, "again", 1), (None, "no id", None), (502, "word " * 60_000, None)]
    docs, labels = frames(rows, "1 AS rules")
    labels = labels.unionByName(labels.limit(5)).unionByName(labels.selectExpr("CAST(NULL AS LONG) doc_id", "quality", "toxic").limit(2))
    more = docs.selectExpr("*", "'x' AS _stat_letters", "2 AS _h", "3 AS label", "4 AS part")
    plain, clashing = (sorted(map(tuple, quality.score_documents(d, labels).collect()), key=str) for d in (docs, more))
    assert plain == clashing and len(plain) == len(rows)
    assert sum(r[0] == 7 for r in plain) == 3 and [r[1] for r in plain if r[0] is None] == [False]
    scored = quality.score(more, quality.Model(0.0))
    assert scored.columns == [*(c for c in more.columns if c != "rules"), "quality_score", "rules"]
    assert {r.quality_score for r in scored.collect()} == {0.5}


def test_one_label_or_none_gives_its_share(frames):
    docs, labels = frames([(i, f"text {i}", 1) for i in range(10)])
    n = quality.labelled(docs, labels).count()
    assert quality.fit(docs, labels).probability()._jc.toString()
    assert {round(r.score, 6) for r in quality.score_documents(docs, labels).collect()} == {round((n + 1) / (n + 2), 6)}
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).collect() == []


def test_equal_texts_are_one_in_the_sample(frames):
    docs, labels = frames([(i, "the same text", int(i % 3 > 0)) for i in range(30)] + [(40, "other", 0)])
    sample = quality.labelled(docs, labels).collect()
    assert sorted(r.label for r in sample) == [0.0, 1.0] or len(sample) == 1


def test_the_sample_takes_few_files_however_wide_keys_are_dealt(frames, monkeypatch):
    """Before, the sample had a file for each of 50 partitions, and another table was written to count its texts."""
    docs, labels = frames(corpus())
    frame, kept = type(docs), []
    wide = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: wide(self, max(n, 50) if cols else n, *cols))
    monkeypatch.setattr(quality, "written", lambda df, name, inner=quality.written: kept.append(name) or inner(df, name))
    sample = quality.labelled(docs, labels)
    assert kept == [] and sample.rdd.getNumPartitions() <= quality.PARTS
    texts = {t: q for i, t, q in corpus() if zlib.crc32(str(i).encode()) % 5}
    assert sorted(r.label for r in sample.collect()) == sorted(texts.values())


def test_penalties_are_fitted_side_by_side(frames, monkeypatch):
    """Before, each of the fits that choose the penalty waited for the one before, and most cores were idle."""
    docs, labels = frames(corpus())
    plain, barrier, seen = quality.LogisticRegression.fit, threading.Barrier(len(quality.PENALTIES)), []

    def fit(self, matrix):
        seen.append(self.getRegParam())
        if len(seen) <= len(quality.PENALTIES):
            barrier.wait(60)  # breaks unless all are there at once
        return plain(self, matrix)

    monkeypatch.setattr(quality.LogisticRegression, "fit", fit)
    model = quality.fit(docs, labels)
    assert sorted(seen[:-1]) == sorted(quality.PENALTIES) and seen[-1] in quality.PENALTIES
    assert model.rules


def test_what_is_no_letter_is_counted_in_what_letters_leave(documents, monkeypatch):
    """Before, eight patterns were each searched in whole texts."""
    calls, plain = [], F.regexp_replace
    monkeypatch.setattr(F, "regexp_replace", lambda of, *a: calls.append(str(of)) or plain(of, *a))
    texts = ["a1b2c3 x.y,z;:", "é!ß?\U0001d49c٣\U0001f600½|Ⅷ|", "{a}[b]\\/<c>@d^_~#$%e&*+=", "..;;", "ǅ" * 9, "1a" * 500]
    got = quality.with_statistics(documents(list(enumerate(texts)))).collect()
    assert sum("regexp_replace" not in c for c in calls) == 3
    for r in got:
        kinds = {"letters": "L", "capitals": "Lu", "digits": "N"}  # of Unicode's categories
        kinds = {name: sum(unicodedata.category(c).startswith(k) for c in r.text) / len(r.text) for name, k in kinds.items()}
        wanted = brute_statistics(r.text) | kinds
        for name in ("letters", "capitals", "digits", "stops", "exclamations", "symbols", "bars"):
            assert r[quality.PREFIX + name] == pytest.approx(wanted[name]), (r.text, name)


def test_bounds_of_a_rule_are_read_to_the_last_digit(documents):
    rows = quality.with_statistics(documents([(0, "a b"), (1, "a  bc"), (2, "")]))
    for at in (2 / 3, 0.1 + 0.2, 1e-05, -1e-300, 3 / 5):
        rule = quality.Rule((("letters", -math.inf, at), ("log_chars", -0.5, math.inf)))
        kept = rows.select(F.col(quality.PREFIX + "letters").alias("x"), rule.column().alias("held")).collect()
        assert all(r.held == (r.x <= at) for r in kept)


def test_a_small_matrix_is_passed_over_without_a_shuffle(frames, monkeypatch):
    """Before, it had a partition for every few files, and each of hundreds of passes was a stage of tasks and a shuffle."""
    docs, labels = frames(corpus())
    plain, seen = quality.LogisticRegression.fit, []

    def fit(self, matrix):
        seen.append((matrix.rdd.getNumPartitions(), matrix.count()))
        return plain(self, matrix)

    monkeypatch.setattr(quality.LogisticRegression, "fit", fit)
    one = quality.fit(docs, labels)
    assert len(seen) == len(quality.PENALTIES) + 1 and {parts for parts, _ in seen} == {1}
    monkeypatch.setattr(quality, "TASK_NUMBERS", 1000)  # a larger one is dealt to more tasks, all rows of it
    rows, seen[:] = sorted(n for _, n in seen), []
    many = quality.fit(docs, labels)
    assert min(parts for parts, _ in seen) > 1 and sorted(n for _, n in seen) == rows
    assert [r for r, _ in many.rules] == [r for r, _ in one.rules]
    assert [w for _, w in many.rules] == pytest.approx([w for _, w in one.rules], abs=1e-6)
