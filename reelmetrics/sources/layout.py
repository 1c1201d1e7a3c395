"""Table layouts that let Spark skip data: month partitions, sorted files, Bloom filters, buckets.

Spark has no indexes; these layouts do the work an index would. They are written below the folder named by
``spark.checkpoint.dir``, once for each state of their source files: a layout is used again only while the files it
was made from are the same, by name, size and time of change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.session import shared_dir

_written: dict[tuple, str] = {}


def state_of(df: DataFrame) -> tuple:
    """What tells one state of the files below ``df`` from another. Reads their listing, not their content."""
    files = df.inputFiles()
    if not files:
        return ()
    listing = df.sparkSession.read.format("binaryFile").load(files)
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return tuple(listing.agg(F.count(F.lit(1)), F.sum("length"), F.sum(mark)).first())


def written_once(df: DataFrame, name: str, write: Callable[[str], None]) -> str:
    """Path of the layout ``name`` of ``df``, written unless this application has one of the same files."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, name, tuple(df.columns), state_of(df))
    if key not in _written:
        path = f"{shared_dir(spark)}/layouts/{uuid.uuid4().hex}/{name}"
        write(path)
        _written[key] = path
    return _written[key]


def partition_by_month(df: DataFrame, timestamp: str, identifier: str, path: str) -> None:
    """Folders ym=200003 below rows, and below days the calendar: a row (ym, day) for each day that has rows.

    The range shuffle gives even tasks and few files per folder.
    """
    month = (F.year(timestamp) * 100 + F.month(timestamp)).alias("ym")
    rows = df.select("*", month).repartitionByRange(timestamp, identifier)
    rows.write.partitionBy("ym").parquet(f"{path}/rows")
    df.select(month, F.to_date(timestamp).alias("day")).distinct().coalesce(1).write.parquet(f"{path}/days")


def sort_files(df: DataFrame, column: str, identifier: str, path: str) -> None:
    """Globally sorted files: each row group covers a narrow range, so min/max skip the rest."""
    rows = df.repartitionByRange(column, identifier).sortWithinPartitions(column)
    rows.write.parquet(path)


def bloom_files(df: DataFrame, column: str, distinct: int, path: str) -> None:
    """Files in the order they come, with a Bloom filter of ``column`` for each row group.

    Equality on a column that files are not sorted by skips the row groups whose filter lacks the value. ``distinct``
    is the number of different values that a row group is expected to hold; it sizes the filter.
    """
    options = {"enabled": "true", "expected.ndv": str(distinct)}
    rows = df.write
    for name, value in options.items():
        rows = rows.option(f"parquet.bloom.filter.{name}#{column}", value)
    # A column that a dictionary covers gets no filter, and needs none.
    rows.parquet(path)


def bucket(df: DataFrame, keys: list[str], buckets: int, table: str, path: str) -> None:
    """Bucketed and sorted table: joins and aggregates on the keys need no shuffle."""
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
