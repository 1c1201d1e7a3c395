"""From raw documents to encoded training text, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept, and but for the last
returns the columns of ``docs``. Null, empty and very long texts, repeated rows and empty tables go through as the
operators' docstrings say: a text without letters has no language and is rejected by the first stage, so no null or
blank text reaches the later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmetrics.llm import decontamination, encoding, langid, simhash, toxicity
from reelmetrics.llm.shared import importable, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; the models learn from these rows' own ``lang``."""
    importable(spark)
    return langid.keep_identified(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below one half; the lexicon learns from ``labels``."""
    importable(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the least doc_id."""
    importable(spark)
    return simhash.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no phrase of ``benchmark``."""
    importable(spark)
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_mapped of every row."""
    importable(spark)
    return encoding.encode_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("toxicity", non_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

# Learned models and fingerprints are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
