"""Customer cohorts: all-of, exactly-one-of and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_counts(df: DataFrame, entity: Sequence[str], item: str, name: str = "n") -> DataFrame:
    """Rows per (entity, item): the pre-aggregate every cohort test starts from."""
    return df.groupBy(*entity, item).agg(F.count(F.lit(1)).alias(name))


def covers_all(counts: DataFrame, entity: Sequence[str], universe: DataFrame, **totals: Column) -> DataFrame:
    """Entities that have every item of ``universe`` (relational division by counting).

    ``counts`` has one row per (entity, item) and ``universe`` one row per item; the universe size
    is a scalar, so nothing is crossed.
    """
    needed = universe.agg(F.count(F.lit(1)).alias("__needed")).scalar()
    per_entity = counts.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("__covered"), *[c.alias(n) for n, c in totals.items()]
    )
    return per_entity.filter(F.col("__covered") == needed).drop("__covered")


def share(hit: Column, weight: Column | None = None) -> Column:
    """Part of the weight (or of the rows) for which ``hit`` holds, as double."""
    w = F.lit(1) if weight is None else weight
    return F.sum(F.when(hit, w).otherwise(0)).cast("double") / F.sum(w).cast("double")
