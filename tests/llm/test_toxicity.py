from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from reelmetrics.llm import toxicity

CLEAN = "the and of house river cloud winter table garden light music paper stone".split()
BAD = "vile scum trash".split()


def brute_segments(scores):
    """All maximal segments by their definition: the best segment, then the same on both sides of it."""
    best, place = 0.0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best + 1e-12 or place and abs(s - best) <= 1e-12 and b - a < place[1] - place[0]:
                best, place = s, (a, b)
    if place is None:
        return []
    a, b = place
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return brute_segments(scores[:a]) + [(a, b, best)] + right


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_the_definition(seed):
    rng = np.random.default_rng(seed)
    places = np.flatnonzero(rng.random(18) < rng.uniform(0.1, 0.8))
    found = [(int(i), float(rng.uniform(0.05, 2))) for i in places]
    scores = [-toxicity.DRIFT] * 18
    for i, s in found:
        scores[i] = s
    got = [(x.first, x.last + 1, x.score) for x in toxicity.segments(found)]
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_surprise_grows_with_scores_and_falls_with_length():
    one = toxicity.surprise([20.0], 100, 0.5, 0.1)
    assert toxicity.surprise([25.0], 100, 0.5, 0.1) > one > toxicity.surprise([20.0], 10_000, 0.5, 0.1)
    assert toxicity.surprise([20.0, 19.0, 18.0], 100, 0.5, 0.1) > one
    assert toxicity.surprise([], 100, 0.5, 0.1) == 0 == toxicity.surprise([0.1], 100, 0.5, 0.1)


def corpus():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(CLEAN, 60).tolist()
        toxic = i % 5 == 0
        if toxic:
            at = int(rng.integers(0, 50))
            words[at : at + 4] = rng.choice(BAD, 4).tolist()
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def labels(llm):
    return lambda rows: llm.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_documents(documents, labels):
    rows, marks = corpus()
    odd = [(None, "vile scum trash vile"), (9001, None), (9002, ""), (5, rows[5][1]), (9003, "House river " * 9000 + "VILE, scum! trash vile scum")]
    marks += [(3, 0, 0), (3, 0, None), (None, 1, 1), (77_777, 1, 1)]
    got = toxicity.score_documents(documents(rows + odd, "'x' AS passages"), labels(marks)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    by_id = {r.doc_id: r for r in got}
    right = [by_id[i].predicted == (i % 5 == 0) for i, _ in rows if by_id[i].held_out]
    assert np.mean(right) > 0.95
    assert by_id[None].predicted == by_id[9003].predicted == 1
    assert by_id[9001].predicted == by_id[9002].predicted == 0


def test_passages_are_places_in_the_text(documents, labels):
    rows, marks = corpus()
    lexicon = toxicity.train(documents(rows), labels(marks))
    text = "The house and É VILE-scum trash vile, the river " + "garden light " * 30 + "trash scum vile."
    (row,) = toxicity.score(documents([(1, text)]), lexicon).collect()
    assert [text[p.begin : p.end] for p in row.passages] == ["VILE-scum trash vile", "trash scum vile"]


def test_kept_rows_and_their_columns(documents, labels):
    rows, marks = corpus()
    docs = documents([*rows, (5, rows[5][1]), (9000, None)], "'x' AS toxicity")
    kept = toxicity.keep_clean(docs, labels(marks))
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    clean = sorted([*(i for i in range(400) if i % 5), 9000])
    assert set(clean) <= set(got) and len(got) <= len(clean) + 6
    assert {r.toxicity for r in kept.collect()} == {"x"}


def test_nothing_to_learn_from(documents, labels):
    assert toxicity.score_documents(documents([]), labels([])).collect() == []
    rows, marks = corpus()
    for some in ([], [m for m in marks if m[2] == 0], [(1, 1, 1)]):
        got = toxicity.score_documents(documents(rows[:10]), labels(some)).collect()
        assert {r.predicted for r in got} == {0} and len(got) == 10


def test_words_follow_their_stems():
    known = {"vile": 3.0}
    lexicon = toxicity.Lexicon(known, {"scumm": 2.0})
    words = ["vile", "scummer", "scumm", "clean"]
    assert toxicity.hits(words, lexicon) == [(0, 3.0), (1, 2.0)]
    assert len(list(itertools.chain(toxicity.segments(toxicity.hits(words, lexicon))))) == 1


def test_a_class_of_long_documents_is_learned_from(documents, labels):
    """Toxic texts are long; most labelled toxic ids have no text, no document, or copies of one text."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(200):
        words = rng.choice(CLEAN, 60 if i % 5 else 14_000).tolist()
        if i % 5 == 0:
            words[7_000:7_008] = rng.choice(BAD, 8).tolist()
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 5 == 0)))
    assert all(len(t) > 65_536 for i, t in rows if i % 5 == 0)
    rows += [(1000 + i, (None, "", "vile scum trash")[i % 3]) for i in range(3000)]
    marks += [(1000 + i, 1, 1) for i in range(6000)]
    found = toxicity.labelled(documents(rows), labels(marks), rows=60).collect()
    usable = {i for i in range(0, 200, 5) if zlib.crc32(str(i).encode()) % 5}
    assert sum(r.toxic for r in found) == len(usable) + 1
    pred = {r.doc_id: r.predicted for r in toxicity.score_documents(documents(rows), labels(marks)).collect()}
    assert np.mean([pred[i] == (i % 5 == 0) for i in range(200)]) > 0.95


def test_calibration_sees_every_segment(documents, labels, monkeypatch):
    rows, marks = corpus()
    for i in range(1000, 1016):
        rows.append((i, f"n{i} " + " ".join(f"vile {' '.join(CLEAN * 2)}" for _ in range(1500))))
        marks.append((i, 1, 1))
    seen, own = [], toxicity.surprise
    monkeypatch.setattr(toxicity, "surprise", lambda scores, *rest: seen.append(len(scores)) or own(scores, *rest))
    toxicity.train(documents(rows), labels(marks))
    assert max(seen) >= 1500
