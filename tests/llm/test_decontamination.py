from __future__ import annotations

import hashlib
import random
import re

import pytest

from reelmetrics.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))


def brute(docs, items, window=10, slop=0):
    phrases = []
    for item_id, text in items:
        w = words(text)
        k = min(window, len(w))
        phrases += [(item_id, w[i : i + k]) for i in range(len(w) - k + 1 if k else 0)]
    found = []
    for doc_id, text in docs:
        w = words(text)
        hit, own = set(), set()
        for item_id, p in phrases:
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    own.add(item_id)
        listed = ",".join(sorted(str(x) for x in own if x is not None))
        found.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "Ccc", "é", "日本", "x1", "the", "The"]
    say = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)]
    docs = [(i, say(rng.randint(0, 60))) for i in range(30)]
    for i in range(30, 50):
        docs.append((i, say(8) + " ; " + rng.choice(items)[1].upper() + " " + say(5)))
    docs += [(50, None), (51, ""), (None, items[5][1]), (31, docs[31][1]), (31, docs[31][1]), (52, (items[7][1] + " q ") * 50)]
    items += [(3, items[3][1]), (4, "another text under one id bb a x1 the the é"), (None, "a bb a bb a bb a bb a bb"), (99, None), (98, " .. ")]
    return docs, items


@pytest.fixture
def benchmark(llm):
    return lambda items: llm.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int").repartition(2)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_documents_equal_brute_force(documents, benchmark, monkeypatch, seed, small):
    docs, items = corpus(seed)
    if small:
        monkeypatch.setattr(decontamination, "CANDIDATES", 3)
    got = decontamination.contaminated_documents(documents(docs, "1 AS n_hit"), benchmark(items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_of_documents_and_of_the_benchmark_do_not_matter(documents, benchmark):
    docs, items = corpus(7)
    index = decontamination.built(documents(docs), block=60)
    found = decontamination.looked_up(index, benchmark(items), queries=40).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found), key=str)
    assert got == sorted((x[:4] for x in brute(docs, items)), key=str)


def test_proximity(documents, benchmark):
    docs = [(1, "one two three four"), (2, "one x two three four"), (3, "one x y two three four"), (4, "four three two one"), (5, "one two"), (6, "three four")]
    look = lambda slop: {r.doc_id for r in decontamination.contamination(documents(docs), benchmark([(1, "one two three four")]), slop=slop).collect() if r["items"]}
    assert look(0) == {1}
    assert look(1) == {1, 2}
    assert look(2) >= {1, 2, 3}


def test_kept_rows_and_their_columns(documents, benchmark):
    docs, items = corpus(1)
    df = documents(docs, "'x' AS n_hit").withColumnRenamed("n_chars", "_hash")
    kept = decontamination.keep_uncontaminated(df, benchmark(items))
    assert kept.columns == df.columns
    clean = [x[0] for x in brute(docs, items) if not x[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(documents, benchmark):
    assert decontamination.contaminated_documents(documents([]), benchmark([(1, "a b")])).collect() == []
    (row,) = decontamination.contaminated_documents(documents([(1, "a b")]), benchmark([])).collect()
    assert tuple(row) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
