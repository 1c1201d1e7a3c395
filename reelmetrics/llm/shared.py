"""Helpers that several operators use: tables written for reuse, hash folds, paths of tokenizer files."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmetrics.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and kept as Parquet in the folder all executors share.

    Cuts the lineage and survives lost executors. The folder is that of ``spark.checkpoint.dir``; a job that is
    over may remove ``llm-<application>`` there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    Executors elsewhere get it as usual, with ``--py-files`` or an installed package.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame) -> DataFrame:
    """The rows with names that clash with nothing an operator adds; ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*(c if c in ("doc_id", "text", "lang") else f"_column_{i}" for i, c in enumerate(docs.columns)))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; NULL for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def appended(batch: pa.RecordBatch, kept: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch, and new ones."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
    return pa.RecordBatch.from_arrays([*columns, *added.values()], names=[*kept, *added])


def below_share(h: Column, share: Column) -> Column:
    """Whether a 64-bit hash lies in the least ``share`` of its range."""
    return h.cast("double") <= share * 2.0**64 - 2.0**63


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; a name that is a path already is kept."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
