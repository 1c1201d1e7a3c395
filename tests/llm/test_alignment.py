from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelmetrics.llm import alignment
from reelmetrics.llm.shared import tokenizer_path


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(tokenizer_path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.SECOND))


def spans_of(text, libraries):
    """(id, begin, end) in bytes of a space and the text, by the libraries alone; None where bytes differ."""
    first, second = libraries
    raw = b" " + text.encode()
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    byte = {chr(b): b for b in range(256) if b not in hidden} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = []
    encoded = first.encode(" " + text, add_special_tokens=False)
    sides = [[(i, bytes(byte[c] for c in first.id_to_token(i))) for i in encoded.ids], []]
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        sides[1].append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    for side in sides:
        if b"".join(x for _, x in side) != raw:
            return None
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(docs, libraries):
    """Rows of the contract, by sets of ends and all pairs."""
    per_doc, counts = [], Counter()
    for doc_id, text in docs:
        spans = spans_of(text, libraries) if text else None
        if spans is None:
            per_doc.append((doc_id, 0, 0, [], Counter()))
            continue
        a, b = spans
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, begin = [], 0
        for cut in cuts:
            groups.append(([i for i, x, e in a if begin <= x and e <= cut], [i for i, x, e in b if begin <= x and e <= cut]))
            begin = cut
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(links.keys())
        per_doc.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for doc_id, n_a, n_b, groups, links in per_doc:
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append((
            doc_id, n_a, n_b, len(groups), sum(links.values()),
            sum(n for (x, y), n in links.items() if counts[x, y] == best[x]),
            sum(n * counts[k] for k, n in links.items()),
            hashlib.sha256(told.encode()).hexdigest() if n_a else "",
        ))
    return rows


def key(row):
    return tuple((v is not None, v) for v in row)


def result(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


HARD = [
    (1, "The quick brown fox"), (2, "The quick brown fox"), (2, "The quick brown fox"), (None, "a b"), (3, None), (4, ""),
    (5, " "), (6, "   lead and  double   spaces  "), (7, "naïve café — 東京 🎉🎉 ǅ"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "mark ▁ inside"), (10, "line\nbreaks\r\n\ttabs\n\n\n"), (11, "!!!!####$$$$%%%%" * 40), (12, "a" * 3000),
    (13, "x\x00y"), (14, "é" * 500 + " ende"), (15, "don't DON'T they're 12345 3.14159"), (16, "​﻿ zero"),
]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_equals_brute_force(documents, libraries, block):
    want = sorted(brute([r[:2] for r in HARD], libraries), key=key)
    assert result(alignment.align_documents(documents(HARD), block=block)) == want
    assert any(r[1] for r in want) and any(r[0] == 9 and not r[1] for r in want)


def test_given_documents(llm, libraries):
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(alignment.align_documents(docs)) == sorted(brute(rows, libraries), key=key)


def test_empty_table_and_clashing_columns(llm, documents):
    assert alignment.align_documents(documents([])).collect() == []
    df = documents([(1, "some words"), (2, "some other words")], "'x' AS block")
    more = df.selectExpr("*", "1 AS n_a", "2 AS links", "'y' AS groups_sha256")
    assert result(alignment.align_documents(more)) == result(alignment.align_documents(df))


def test_other_types_of_id(llm):
    df = llm.createDataFrame([("a", "some words"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in alignment.align_documents(df).collect()} == {"a", None}


def test_both_libraries_cut_every_character_alike(libraries):
    with open(tokenizer_path(alignment.FIRST), "rb") as first, open(tokenizer_path(alignment.SECOND), "rb") as second:
        tools = alignment.Tokenizers(first.read(), second.read())
    assert tools.fast is not None
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(characters), 50_000):
        texts = [f" x{c}y1{c}2 {c}!{c}'s{c} \n{c}" for c in characters[at : at + 50_000]]
        want = libraries[0].encode_batch_fast(texts, add_special_tokens=False)
        assert [tools.fast.encode_ordinary(t) for t in texts] == [x.ids for x in want]
    for text in (" " * 300_000 + "x", "\n" * 5000, "ab" * 20_000):
        assert tools.first_ids(text) == libraries[0].encode(text, add_special_tokens=False).ids


ENDS = st.lists(st.integers(1, 300), min_size=1, max_size=60, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.integers(1, 4))
def test_cuts_are_the_common_ends(a, b, pieces):
    a, b = np.array(a + [400]), np.array(b + [400])
    edges = np.linspace(0, len(a) - 1, pieces + 1).astype(int)
    got = alignment.shared_cuts(a, b, edges[:-1], edges[1:])
    assert a[got].tolist() == sorted(set(a[:-1].tolist()) & set(b.tolist()))


def test_links_of_a_large_group_are_summed():
    a, b = np.array([1, 1, 2] * 50), np.array([7] * 100 + [8] * 20)
    parts = list(alignment._links(a, b, np.array([150]), np.array([120]), np.array([0])))
    doc, link, times = alignment._summed(parts)
    found = {(x // alignment.ID, x % alignment.ID): t for x, t in zip(link.tolist(), times.tolist())}
    assert found == {(1, 7): 10000, (1, 8): 2000, (2, 7): 5000, (2, 8): 1000}
    assert sum(len(p[0]) for p in parts) == 4 and set(doc.tolist()) == {0}
