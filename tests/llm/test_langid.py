from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from reelmetrics.llm import langid

WORDS = {"en": "the and of thing that with was".split(), "de": "der und von keit schön über ist".split(), "fr": "le et de être où ça leçon".split()}


def text_of(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def brute_bits(texts, order, text, kept, symbol, width):
    """Bits of a text under one language, by the definition, context by context, from counts in dicts."""
    counts = {}
    for t in texts:
        s = [0] * order + [int(symbol[b]) for b in t]
        for i in range(order, len(s)):
            for k in range(order + 1):
                c = tuple(s[i - k : i])
                if k == 0 or c in kept:
                    counts.setdefault(c, {}).setdefault(s[i], 0)
                    counts[c][s[i]] += 1
    n_symbols = len(width)

    def probabilities(c):
        below = [w / 256 for w in width] if not c else probabilities(c[1:])
        seen = counts.get(c, {})
        if not seen:
            return below
        n, q = sum(seen.values()), len(seen)
        left = sum(below[s] for s in range(n_symbols) if s not in seen)
        scale = n + q if left > 0 else n
        return [seen[s] / scale if s in seen else (q / scale * below[s] / left) for s in range(n_symbols)]

    s = [0] * order + [int(symbol[b]) for b in text]
    bits = 0.0
    for i in range(order, len(s)):
        c = ()
        for k in range(1, order + 1):
            if tuple(s[i - k : i]) not in kept:
                break
            c = tuple(s[i - k : i])
        bits -= math.log2(probabilities(c)[s[i]] / width[s[i]])
    return bits


@pytest.mark.parametrize("contexts", [10_000, 40])
def test_code_lengths_equal_brute_force(contexts):
    texts = {x: [text_of(x, i, 12).encode() for i in range(3)] for x in WORDS}
    trees = langid.fitted(texts, 3, contexts)
    every = {}
    for x in texts:
        for t in texts[x]:
            s = [0] * 3 + [int(trees.symbol[b]) for b in t]
            for i in range(3, len(s)):
                for k in range(1, 4):
                    c = tuple(s[i - k : i])
                    every[c] = every.get(c, 0) + 1
    ranked = sorted(every.values(), reverse=True)
    least = ranked[contexts - 3] + 1 if len(ranked) > contexts - 2 else 1
    kept = {c for c, n in every.items() if n >= least}
    width = np.bincount(trees.symbol, minlength=trees.n_symbols).tolist()
    probes = [b"", b"the thing", "über ça Zq!".encode(), text_of("fr", 9).encode(), b"THE AND"]
    offsets = np.cumsum([0] + [len(p) for p in probes])
    got = langid.code_lengths(trees, np.frombuffer(b"".join(probes), np.uint8), offsets)
    for j, x in enumerate(trees.languages):
        for i, p in enumerate(probes):
            assert got[i, j] == pytest.approx(brute_bits(texts[x], 3, p, kept, trees.symbol, width), rel=1e-5, abs=1e-9)


def test_probabilities_sum_to_one_and_blocks_do_not_matter():
    texts = {x: [text_of(x, i).encode() for i in range(5)] for x in WORDS}
    trees = langid.fitted(texts)
    p = np.exp2(-trees.cost[trees.n_symbols : -1].astype(float)).reshape(-1, trees.n_symbols, 3)
    width = np.bincount(trees.symbol, minlength=trees.n_symbols)
    assert np.allclose((p * width[None, :, None]).sum(1), 1, atol=1e-5)
    probes = [text_of("de", 1, 400).encode(), b"", b"x", text_of("en", 2, 90).encode()]
    offsets = np.cumsum([0] + [len(q) for q in probes])
    data = np.frombuffer(b"".join(probes), np.uint8)
    assert np.allclose(langid.code_lengths(trees, data, offsets), langid.code_lengths(trees, data, offsets, block=7))


def rows():
    found = [(i, text_of(x, i), x) for i, x in enumerate(list(WORDS) * 20)]
    return found + [(None, text_of("en", 1), "en"), (500, None, "en"), (501, "", "de"), (502, " 123 !? ", "fr"), (503, text_of("de", 77), None), (7, text_of("de", 7, 20_000), "de"), (7, text_of("de", 7), "de")]


def test_documents(documents):
    got = langid.predict_documents(documents(rows(), "'x' AS lang_pred").withColumnRenamed("n_chars", "score")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert {pred[i] for i in (500, 501, 502)} == {("und", 0.0)}
    assert all(pred[i][0] == x for i, t, x in rows() if i is not None and x and i < 500)
    assert pred[503][0] == "de"


def test_kept_rows_and_their_columns(documents):
    docs = documents(rows(), "'x' AS bits_per_byte")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    want = sorted(str((i, t)) for i, t, _ in rows() if i not in (500, 501, 502))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want
    assert {r.bits_per_byte for r in kept.collect()} == {"x"}


def test_nothing_to_learn_from(documents):
    assert langid.predict_documents(documents([])).collect() == []
    docs = documents([(1, "the thing", "en")]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert [(r.lang_pred, r.score) for r in langid.predict_documents(docs).collect()] == [("und", 0.0)]


def test_every_language_is_learned_from(documents):
    """One has only long texts; one few texts among many null, empty and letterless ones, and copies of an id."""
    docs = [(i, text_of("en", i), "en") for i in range(60)]
    docs += [(100 + i, text_of("de", i, 9000), "de") for i in range(9)]
    docs += [(10_000 + i, (None, "", " 12 ")[i % 3], "fr") for i in range(3000)]
    docs += [(20_000, text_of("fr", 0), "fr")] * 3000
    docs += [(200 + i, text_of("fr", i), "fr") for i in range(9)]
    assert all(len(t.encode()) > langid.SAMPLE_BYTES for _, t, x in docs if x == "de")
    df = documents(docs)
    found = langid.sample(df).collect()
    assert all(len(r.text) <= langid.SAMPLE_BYTES for r in found)
    usable = {(x, i) for i, t, x in docs if t and t.strip(" 12") and zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(r.lang for r in found) == sorted(x for x, _ in usable)
    pred = {r.doc_id: r.lang_pred for r in langid.predict_documents(df).collect()}
    assert all(pred[i] == x for i, t, x in docs if i < 1000)


def test_stretches_of_long_texts_lie_apart_and_hold_whole_characters(documents):
    docs = [(i, "".join(chr(0x4E00 + j) for j in range(20_000)), "zh") for i in range(30)]
    found = [bytes(r.text) for r in langid.sample(documents(docs), size=1000).collect()]
    assert all(len(t) == 1000 for t in found) and len(set(found)) > 10
    trees = langid.train(documents(docs), size=1000)
    assert trees.languages == ["zh"]
