"""Keeping window functions away from hot groups.

A window function runs one group in one task. When one key holds a large share of the rows that task never ends. A
*slice* is an order-preserving function of the sort column. A window per (key, slice) plus a small table with one
row per slice, which carries the value across slice borders, gives the same result as one window per key. Every key
is treated alike, so nothing has to be known about the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = "__slice"

LOWEST = -(2**40)


# Bins per factor of e. A 64-bit number has under 44 factors of e, so no column has more than 720,000 bins, however
# its values are spread.
BINS = 2**13


def number_slice(value: str, bins: int = BINS) -> Column:
    """Monotone bins of relative width 1/bins: no statistics needed, so every branch agrees.

    NULL has a bin below all others, as in the sort order.
    """
    v = F.col(value).cast("double")
    return F.coalesce(F.floor(F.signum(v) * F.log1p(F.abs(v)) * bins).cast("long"), F.lit(LOWEST))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL with NULL, as window partitions do.

    It also keeps Catalyst from adding not-null filters to one of several branches over the same
    rows, so the branches can share their shuffles.
    """
    names = {c: f"__right_{i}" for i, c in enumerate(on)}
    renamed = right.withColumnsRenamed(names)
    same = None
    for c, n in names.items():
        nullable = left.schema[c].nullable or right.schema[c].nullable
        eq = F.col(c).eqNullSafe(F.col(n)) if nullable else F.col(c) == F.col(n)
        same = eq if same is None else same & eq
    return left.join(renamed, same, how).drop(*names.values())
