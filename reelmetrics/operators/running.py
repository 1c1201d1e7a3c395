"""Running totals: rows with equal sort keys are peers and share one value.

The results come in the order of keys and moment, range after range, so that order needs no sort of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.operators.ranges import RANGE, border_keys, ranged, with_borders

BEFORE = (Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """Total of ``value`` up to and including the current ``order`` moment, per key; NULL is a key like others.

    A prefix sum over ranges of (key, moment): each range sums by itself, and a key that is open at its border gets
    the total of the ranges before. A moment that is cut by a border also gets its rows in the ranges after.
    """
    keys = list(keys)
    rows = ranged(df.withColumn("__v", value), keys, [order])
    within = Window.partitionBy(RANGE, *keys)
    local = rows.withColumn("__local", F.sum("__v").over(within.orderBy(order)))
    borders = border_keys(local, keys, _moment_stats(order) | {"__total": F.sum("__v")})
    along = Window.partitionBy(*keys).orderBy(RANGE)
    borders = _with_tail(borders, keys).withColumn("__carry", F.sum("__total").over(along.rowsBetween(*BEFORE)))
    joined = with_borders(local, borders, keys, within, ["__carry", "__tail", "__last"])
    return joined.select(*df.columns, _added("__local", "__carry", _tail_of(order)).alias(name))


def _moment_stats(order: str) -> dict[str, Column]:
    """First and last moment of a key in a range, in a struct as NULL is a moment too, and the total at the first."""
    moment = F.struct(F.col(order).alias("moment"))
    return {"__first": F.min(moment), "__last": F.max(moment), "__first_total": F.min_by("__local", moment)}


def _with_tail(borders: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__tail``: the total of the last moment's rows that lie in later ranges."""
    along = Window.partitionBy(*keys).orderBy(RANGE)
    same = Window.partitionBy(*keys, "__first").orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, 0)
    borders = borders.repartition(*keys)  # one small shuffle for all windows over the borders
    onward = borders.withColumn("__onward", F.sum("__first_total").over(same))
    goes_on = F.lead("__first").over(along) == F.col("__last")
    return onward.withColumn("__tail", F.when(goes_on, F.lead("__onward").over(along)))


def _tail_of(order: str) -> Column:
    return F.when(F.col(order).eqNullSafe(F.col("__last.moment")) & F.col("__last").isNotNull(), F.col("__tail"))


def _added(first: str, *others: str | Column) -> Column:
    """Sum that skips NULL, and is NULL if all are, like SUM itself."""
    total = F.col(first)
    for other in (F.col(c) if isinstance(c, str) else c for c in others):
        total = F.coalesce(total + other, total, other)
    return total


Breaks = Callable[[Column, Column], Column]


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def running_total_with_reset(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, breaks: Breaks, name: str
) -> DataFrame:
    """Running total that starts again where ``breaks(previous, current)`` is true; never between equal moments.

    A segmented prefix sum over ranges of (key, moment). Of a key that is open at a border a range hands on its last
    moment, the total since its last reset and whether it had one. In the order of the ranges these make chains that
    a reset, inside a range or on its border, begins anew.
    """
    keys = list(keys)
    rows = ranged(df.withColumn("__v", value), keys, [order])
    within = Window.partitionBy(RANGE, *keys)
    by_moment = within.orderBy(order)
    local = (
        rows.withColumn("__reset", _flag(breaks(F.lag(order).over(by_moment), F.col(order))))
        .withColumn("__group", F.sum("__reset").over(by_moment))
        .withColumn("__local", F.sum("__v").over(Window.partitionBy(RANGE, *keys, "__group").orderBy(order)))
    )
    open_total = F.max_by("__local", F.struct(F.col(order).alias("moment")))
    borders = border_keys(local, keys, _moment_stats(order) | {"__since": open_total, "__resets": F.max("__group")})
    along = Window.partitionBy(*keys).orderBy(RANGE)
    chains = (
        _with_tail(borders, keys)
        .withColumn("__anew", _flag(breaks(F.lag("__last.moment").over(along), F.col("__first.moment"))))
        .withColumn("__chain", F.sum(F.greatest("__anew", F.least("__resets", F.lit(1)))).over(along))
        .withColumn("__open", F.sum("__since").over(Window.partitionBy(*keys, "__chain").orderBy(RANGE)))
        .withColumn("__carry", F.when(F.col("__anew") == 0, F.lag("__open").over(along)))
    )
    joined = with_borders(local, chains, keys, within, ["__carry", "__tail", "__last"])
    carried = F.when(F.col("__group") == 0, F.col("__carry"))
    return joined.select(*df.columns, _added("__local", carried, _tail_of(order)).alias(name))
