"""Windows over ranges of sorted rows, with what crosses their borders.

Rows are cut into ranges of (keys, order) of about equal size, so a hot key is cut like the rest of the table and a
small key mostly lies in one range. Windows run inside a range. Only the first and the last key of a range can go
on in another one, so what ranges hand to one another is at most two rows each, however many keys there are: it is
worked out over those rows and broadcast back, and its size is bounded by the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmetrics.operators.slices import join_null_safe

RANGE = "__range"
SIGN, ROWS, SEEN = "__sign", "__rows", "__seen"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with the number of their range, each range in one partition.

    Rows that are equal in keys and order may be cut apart too, by a number of their own.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, "__tie")
    signed = cut.withColumn(RANGE, F.spark_partition_id()).drop("__tie").withColumn(SIGN, F.xxhash64(*df.columns))
    return signed.repartitionById(n, RANGE)


def border_keys(rows: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """(range, keys, stats): of every range its first and its last key, with aggregates of their rows in it.

    Without keys it is one row for each range.
    """
    each = rows.groupBy(RANGE, *keys).agg(
        *(c.alias(n) for n, c in stats.items()), F.count(F.lit(1)).alias(ROWS), F.max(SIGN).alias(SEEN)
    )
    if not keys:
        return each
    row = F.struct(*keys, *stats, ROWS, SEEN)
    ends = each.groupBy(RANGE).agg(F.array_distinct(F.array(F.min(row), F.max(row))).alias("__ends"))
    return ends.select(RANGE, F.inline("__ends"))


def with_borders(rows: DataFrame, borders: DataFrame, keys: Sequence[str], within: Column, carried: Sequence[str]) -> DataFrame:
    """Rows joined with what their range and key got over the border; NULL for keys that lie inside a range.

    ``within`` is a window over (range, keys). Both sides read the same shuffle. Should a plan ever compute it
    twice, with other ranges, their counts or signs differ and the query fails.
    """
    sides = borders.select(RANGE, *keys, *carried, ROWS, SEEN)
    own = rows.withColumn("__own_rows", F.count(F.lit(1)).over(within)).withColumn("__own_seen", F.max(SIGN).over(within))
    joined = join_null_safe(own, F.broadcast(sides), [RANGE, *keys], "left")  # two rows a range at most
    differs = (F.col("__own_rows") != F.col(ROWS)) | (F.col("__own_seen") != F.col(SEEN))
    guarded = {c: F.when(differs, F.raise_error(F.lit("ranges differ between branches"))).otherwise(F.col(c)) for c in carried}
    return joined.withColumns(guarded)
