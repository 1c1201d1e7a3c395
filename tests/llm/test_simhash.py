from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from reelmetrics.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, limit=3):
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= limit:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def clustered(seed, n):
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(max(n // 4, 1))]
    while len(found) < n:
        found.append(flipped(rng, rng.choice(found), rng.randint(0, 5)))
    return found


TEXTS = [None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "É é \x1c x", "\x85next line\x85 a b", "w " * 70_000, " ".join(map(str, range(300)))]


def test_fingerprints_equal_brute_force():
    got = simhash.fingerprints(TEXTS)
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("n", [1, 2, 17, 600])
def test_tree_finds_every_pair(n):
    members = np.unique(np.array(clustered(n, n), np.uint64))
    q, m = simhash.Tree(members).search(members, 3)
    want = {(i, j) for i, x in enumerate(members) for j, y in enumerate(members) if (int(x) ^ int(y)).bit_count() <= 3}
    assert len(q) == len(want) and set(zip(q.tolist(), m.tolist())) == want


@pytest.mark.parametrize("chunk", [4096, 5])
def test_groups_equal_brute_force(llm, chunk):
    values = clustered(3, 400) + [flipped(random.Random(i), 7, 2) for i in range(40)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = llm.createDataFrame([(v,) for v in set(signed)], "fingerprint long")
    linked = components.components(simhash.links(df, 3, chunk))
    root = {r.node: r.root for r in linked.collect()}
    mine = [root.get(v, v) for v in signed]
    want = brute_groups(values)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_documents(documents):
    rng = random.Random(5)
    base = [" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=400)) for _ in range(6)]
    texts = base + base[:3] + [b + " zz" for b in base] + TEXTS
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, base[0]), (7, base[1]), (7, base[1])]
    got = simhash.group_documents(documents(rows, "'x' AS fingerprint")).collect()
    values = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups(values)
    least = {g: min(r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None) for g in groups}
    want = sorted(((r[0], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, groups)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_one_row_of_each_group_stays(documents):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (9, "totally other words here"), (8, None), (6, "")]
    docs = documents(rows, "'x' AS fingerprint")
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, "a b c d"), (None, "q r s t u"), (9, "totally other words here"), (6, "")], key=str)


def test_empty_table(documents):
    assert simhash.group_documents(documents([])).collect() == []
    assert simhash.one_of_each_group(documents([])).collect() == []


def test_components_of_a_long_chain_and_a_star(llm):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(1).shuffle(chain)
    star = [(1000 + i, 5000) for i in range(300)]
    df = llm.createDataFrame([*chain, *star, (7, 7), (None, 3), (9999, 9999)], "x long, y long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 1000}
