from __future__ import annotations

import random

import pytest

import corpus_pipeline
from reelmetrics.llm import queries

WORDS = {"en": "the and of thing that with was hand river".split(), "de": "der und von keit schön über ist haus".split()}
BAD = "vile scum trash".split()
PHRASE = "one quite special benchmark passage of exactly twelve words stands right here"


def corpus():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        words = rng.choices(WORDS[lang], k=80)
        toxic = i % 5 == 0
        if toxic:
            words[10:14] = rng.choices(BAD, k=4)
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 5]
    docs += [(1000 + k, clean[k][1], clean[k][2], "s", 0) for k in range(10)]  # exact copies
    docs += [(2000, clean[20][1] + " " + PHRASE, "en", "s", 0), (2001, None, "en", "s", 0), (2002, "12 34", None, "s", 0), (None, " ".join(rng.choices(WORDS["en"], k=60)), "en", "s", 0)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = corpus()
    llm.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    llm.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_keeps_what_it_should(llm, folder):
    docs, _ = corpus()
    got = corpus_pipeline.run(llm, folder)
    kept = [r.doc_id for r in got.collect()]
    want = [i for i in range(240) if i % 5] + [None]
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_stages_give_the_columns_of_documents(llm, folder):
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm, docs, folder).columns == docs.columns


def test_stages_take_empty_tables(llm, folder):
    docs = llm.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(llm, docs, folder).collect() == []


def test_five_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
