from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmetrics.llm import encoding, pieces, token_counts
from reelmetrics.llm.shared import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
with open(MODEL, "rb") as file:
    DATA = file.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=DATA)
PARTS = ["a", "th", "e", "ing", " the", " ", "  ", "\n", "\t", "é", "①", "日本", "▁", "<s>", "</s>", "<0x41>", "12", "%%%", "😀", "\x00", "ﬁ", "́", "hahaha", "_____", "https://", "aaaaaaaa", " "]
TEXTS = [None, "", " ", "  ", "\n", " \n ", "a", "x" * 5000, " " * 3000, "\n" * 50, "ab " * 4000, "é́①日本 " * 300]


def mixed(seed):
    rng = random.Random(seed)
    return "".join(rng.choices(PARTS, k=rng.randint(0, 30)))


def surfaces(text, ids, places):
    raw = text.encode()
    return [raw[places[i] : places[i + 1]] for i in range(len(ids))]


@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
@settings(max_examples=300, deadline=None)
def test_ids_spans_and_text_equal_the_library(text):
    encoder, decoder = encoding.Encoder(DATA), encoding.Decoder(pieces.tools(DATA)[0])
    ids, places = encoder.encode(text)
    want = LIBRARY.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in want]
    assert surfaces(text, ids, places) == [p.surface.encode() for p in want]
    assert decoder.decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
    counter = token_counts.Counter(pieces.tools(DATA)[2])
    norm = pieces.tools(DATA)[1].recorded(text)[0]
    whole = token_counts.composed([counter.chunk_map(norm[a : a + 7]) for a in range(0, max(len(norm), 1), 7)], counter.compose)
    assert counter.total(whole) == counter.total(counter.chunk_map(norm)) == len(want)


@given(st.lists(st.one_of(st.integers(1, 258), st.integers(259, 31_999), st.sampled_from([1, 2, 29_871])), max_size=8))
@settings(max_examples=300, deadline=None)
def test_decoding_any_ids_equals_the_library(ids):
    assert encoding.Decoder(pieces.tools(DATA)[0]).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normalisation_by_a_compiled_map_equals_the_library(rule):
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(pieces._fields(dict(pieces._fields(normal.serialized_model_proto()))[3]))
    base = pieces.tools(DATA)[0]
    model = pieces.PieceModel(**{**vars(base), "charsmap": spec[2], "dummy_prefix": True, "trim_spaces": True, "escape_spaces": True})
    mine = pieces.Normalizer(model)
    for seed in range(400):
        text = mixed(seed) + random.Random(seed).choice(["", "Ａｂｃ", "ﷺ", "㌔", "①②", "é", "　", "ｶﾞ"])
        got, align = mine.normalized(text)
        want = normal.normalize(text)
        assert got == want, text
        assert len(align) == len(got.encode()) + 1 and align == sorted(align) and align[-1] <= len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_spans_under_any_map_lie_end_to_end(rule, trim):
    """One path for all models: pieces of a normalised text have the source bytes that the library gives them."""
    charsmap = b""
    if rule != "identity":
        normal = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        charsmap = dict(pieces._fields(dict(pieces._fields(normal.serialized_model_proto()))[3]))[2]
    encoder = encoding.Encoder(DATA)
    encoder.normalizer = pieces.Normalizer(pieces.PieceModel(**{**vars(encoder.model), "charsmap": charsmap, "trim_spaces": trim}))
    for seed in range(200):
        text = mixed(seed) + random.Random(seed).choice(["", "Ａｂｃ", "ﷺ x", "㌔", "①②", "  é ", "　", "ｶﾞ"])
        norm, align = encoder.normalizer.normalized(text)
        ids, places = encoder.encode(text)
        assert len(places) == len(ids) + 1 and (np.diff(places.astype(int)) >= 0).all()
        ends = np.concatenate([[0], np.cumsum(encoder.covered(ids))])
        assert ends[-1] == len(norm.encode()) and [align[e] for e in ends] == places.tolist()


def test_trimming_normalisation():
    base = pieces.tools(DATA)[0]
    model = pieces.PieceModel(**{**vars(base), "trim_spaces": True})
    n = pieces.Normalizer(model)
    assert n.normalized("  a   b ")[0] == "▁a▁b"
    assert n.normalized("  a   b ")[1] == [2, 2, 2, 2, 3, 3, 3, 6, 7]
    assert n.normalized("   ") == ("", [0])


@pytest.mark.parametrize("chunk", [1, 3, 7, 50])
def test_chunk_maps_compose_in_any_grouping(chunk):
    counter = token_counts.Counter(pieces.tools(DATA)[2])
    for seed in range(60):
        text = mixed(seed) * 3
        norm = "▁" + text.replace(" ", "▁")
        maps = [counter.chunk_map(norm[a : a + chunk]) for a in range(0, len(norm), chunk)]
        want = len(LIBRARY.encode(text)) if text else counter.count("▁")
        if maps:
            assert counter.total(token_counts.composed(maps, counter.compose)) == want
        one_by_one = maps[0]
        for m in maps[1:]:
            one_by_one = counter.compose(one_by_one, m)
        assert counter.total(one_by_one) == want


def test_a_long_text_without_spaces_is_held_once_a_level():
    """Its chunks' maps are texts; composing all of them neither keeps prefixes nor counts anything twice."""
    counter = token_counts.Counter(pieces.tools(DATA)[2])
    text = "".join(random.Random(1).choices("abcdefgh0123+/", k=400_000))
    maps = [counter.chunk_map(("▁" if a == 0 else "") + text[a : a + 1000]) for a in range(0, len(text), 1000)]
    held = []

    def compose(x, y):
        made = counter.compose(x, y)
        held.append(len(made.head) + len(made.tail or ""))
        return made

    assert counter.total(token_counts.composed(maps, compose)) == len(LIBRARY.encode(text))
    assert sum(held) <= 10 * len(text) and len(held) == len(maps) - 1


def test_tables_are_made_anew_beyond_their_limit(monkeypatch):
    machine = pieces.Transducer(pieces.loaded(DATA))
    monkeypatch.setattr(machine, "LIMIT", 5)
    for seed in range(50):
        text = mixed(seed)
        if text:
            norm = "▁" + text.replace(" ", "▁")
            assert machine.count(norm) == len(LIBRARY.encode(text))
            assert len(machine.pieces(norm)) <= machine.count(norm)


def test_different_words_of_a_block_are_merged_once_and_together(monkeypatch):
    """Before, each word met for the first time was merged by itself."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("etaoinsé日😀\x00'.", k=rng.randint(1, 30))) for _ in range(3000)})
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(30)] + [t or "" for t in TEXTS] + [mixed(s) for s in range(60)]
    merged, inner = [], pieces.Merges.ids
    monkeypatch.setattr(pieces.Merges, "ids", lambda self, texts: merged.append(texts) or inner(self, texts))
    got = encoding.Encoder(DATA).encode_all(texts)
    assert [ids.tolist() for ids, _ in got] == [LIBRARY.encode(t) for t in texts]
    assert all(places[-1] == len(t.encode()) and len(places) == len(ids) + 1 for t, (ids, places) in zip(texts, got))
    assert len(merged) <= len(encoding.SHORT)
    assert max(Counter(sum(merged, [])).values()) <= 2  # as a word, and in texts with runs of marks
    decoder = encoding.Decoder(pieces.tools(DATA)[0])
    marked = [np.array([1, *ids, 2], "<u4") for ids, _ in got] + [np.array(x, "<u4") for x in ([], [2], [2, 5, 1, 300], [29_871, 229, 153, 132])]
    assert decoder.decode_all(marked) == [LIBRARY.decode(x.tolist()) for x in marked]


@pytest.mark.parametrize("seed", range(30))
def test_merging_together_equals_merging_one_by_one(seed):
    """Also with equal scores, with scores that don't fall with length, and with a character that only longer pieces hold."""
    rng = random.Random(seed)
    names = ["a", "b", *sorted({"".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(25)})]
    base = pieces.tools(DATA)[0]
    scores = {n: float(-rng.randint(0, 12)) for n in names}
    ids = {n: i + 256 for i, n in enumerate(names)}
    model = pieces.PieceModel(**{**vars(base), "ids": ids, "scores": scores, "names": [""] * 256 + names, "byte_ids": list(range(256))})
    texts = ["".join(rng.choices("abcdé", [6, 6, 6, 1, 1], k=rng.randint(1, 20))) for _ in range(200)]
    got, many = pieces.Merges(model).ids(texts)
    want = [[i for p in pieces.merged(t, scores)[0] for i in ([ids[p]] if p in ids else p.encode())] for t in texts]
    assert got.tolist() == sum(want, []) and many.tolist() == [len(w) for w in want]


def rows():
    texts = TEXTS + [mixed(s) for s in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_count_documents(documents, chunk):
    got = token_counts.count_documents(documents(rows(), "1 AS n_tokens"), limit=100, chunk=chunk).collect()
    want = sorted(((i, len((t or "").encode()), n, n > 100) for i, t in rows() for n in [len(LIBRARY.encode(t or ""))]), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_encode_documents(documents):
    got = encoding.encode_documents(documents(rows(), "1 AS ids")).collect()
    want = []
    for i, t in rows():
        ids = [1, *LIBRARY.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decoding_apart_gives_the_same(documents):
    encoded = encoding.encode(documents(rows()), marks=False, decoded=True).withColumnRenamed("decoded", "at_once")
    got = encoding.decode(encoded).collect()
    assert all(r.decoded == r.at_once == LIBRARY.decode(LIBRARY.encode(r.text or "")) for r in got)


def test_empty_table(documents):
    assert token_counts.count_documents(documents([])).collect() == []
    assert encoding.encode_documents(documents([])).collect() == []
