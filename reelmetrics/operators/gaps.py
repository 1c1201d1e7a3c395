"""Neighbouring events of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.operators.ranges import RANGE, border_keys, ranged, with_borders


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, identifier: str | None = None,
    previous: str = "previous", following: str = "following",
) -> DataFrame:
    """keys, order, and the ``order`` value of the row before and after, per key; NULL is a key like others.

    Rows of the same moment follow each other in the order of ``identifier``, where there is one. Inside a range of
    (key, moment, identifier) neighbours are found by a window; of a key that is open at a border, a range hands on
    its first and its last moment only.
    """
    keys = list(keys)
    ordered = [order, identifier] if identifier else [order]
    rows = ranged(df.select(*keys, *ordered), keys, ordered)
    within = Window.partitionBy(RANGE, *keys)
    w = within.orderBy(*ordered)
    moment = F.struct(F.col(order).alias("moment"))  # NULL is a moment too
    borders = border_keys(rows, keys, {"__first": F.min(moment), "__last": F.max(moment)})
    along = Window.partitionBy(*keys).orderBy(RANGE)
    borders = borders.withColumn("__before", F.lag("__last").over(along)).withColumn("__after", F.lead("__first").over(along))
    joined = with_borders(rows, borders, keys, within, ["__before", "__after"])
    is_first, is_last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return joined.select(
        *keys,
        order,
        F.when(is_first, F.col("__before.moment")).otherwise(F.lag(order).over(w)).alias(previous),
        F.when(is_last, F.col("__after.moment")).otherwise(F.lead(order).over(w)).alias(following),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows per key; the limit is applied on each map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= n)
