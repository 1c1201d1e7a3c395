"""Period series: comparisons, rolling frames, dense calendars and streaks.

These run on aggregates with one row per (key, period). Such a group is bounded by the calendar,
so its window is small whatever the size of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(by: Sequence[str], *order: str):
    return Window.partitionBy(*by).orderBy(*order)


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The value of the previous period present."""
    return df.withColumn(name, F.lag(value).over(series(by, *order)))


def value_at(by: Sequence[str], index: str, value: str, offset: int) -> Column:
    """The value exactly ``offset`` periods away, NULL if that period is absent."""
    return F.sum(value).over(series(by, index).rangeBetween(offset, offset))


def dense_calendar(df: DataFrame, by: Sequence[str], index: str, values: dict[str, object]) -> DataFrame:
    """One row per key for each period between its first and last; absent periods get ``values``.

    Each period present is written out up to the next one, so no calendar has to be joined.
    """
    until = F.coalesce(F.lead(index).over(series(by, index)) - 1, F.col(index))
    filled = df.withColumn("__until", until).withColumn("__at", F.explode(F.sequence(index, "__until")))
    present = F.col("__at") == F.col(index)
    columns = [
        F.coalesce(F.when(present, F.col(name)), F.lit(absent)).alias(name) for name, absent in values.items()
    ]
    return filled.select(*by, F.col("__at").alias(index), *columns)


def streaks(df: DataFrame, by: Sequence[str], index: str, at_least: int) -> DataFrame:
    """Runs of consecutive ``index`` values: first, last and length; repeated and null values do not matter.

    A key's periods are gathered as a set, on each map task first, and its runs read off the sorted set: a run
    begins where the period before is absent and ends where the next one is. One shuffle, and no window.
    """
    sets = df.groupBy(*by).agg(F.sort_array(F.collect_set(index)).alias("__set"))
    every = F.col("__set")
    first = F.filter(every, lambda x, i: (i == 0) | (x - F.get(every, i - 1) > 1))
    last = F.filter(every, lambda x, i: (i == F.size(every) - 1) | (F.get(every, i + 1) - x > 1))
    runs = F.arrays_zip(first.alias("first_index"), last.alias("last_index"))
    length = (F.col("last_index") - F.col("first_index") + 1).alias("length")
    found = sets.select(*by, F.inline(runs)).toDF(*by, "first_index", "last_index")
    return found.select("*", length).filter(F.col("length") >= at_least)
