"""Ranks, row numbers and tiles.

Three situations, three plans:

* the best few, where ties are rare or the groups small: a plain rank window plus filter, which
  Catalyst turns into a ``WindowGroupLimit`` on the map side (:func:`top`);
* the best few by a count, where very many rows may tie: the best distinct values are found first
  and the rows that have them are kept (:func:`top_by_value`);
* every row gets a rank: places are computed once per distinct value, over ranges of the value, and
  joined back (:func:`ranked`, :func:`numbered`);
* tiles over the whole table: rows are numbered inside even ranges, after the rows of the ranges before (:func:`tiled`).

Nothing is broadcast by a hint but one row for each range, whose number is that of the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmetrics.operators.ranges import RANGE, ROWS, border_keys, ranged, with_borders
from reelmetrics.operators.slices import SLICE, join_null_safe, number_slice

KINDS = {"rank": F.rank, "dense": F.dense_rank, "row": F.row_number}


def small_rank(by: Sequence[str], order: Sequence[Column], kind: str = "rank") -> Column:
    """Rank over groups with a known small size (months, staff, stores, categories)."""
    return KINDS[kind]().over(Window.partitionBy(*by).orderBy(*order)).cast("long")


def top(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    kind: str = "rank",
    name: str = "rank",
) -> DataFrame:
    """Rows whose rank is at most ``n``; all ties of the last rank stay."""
    return df.withColumn(name, small_rank(by, order, kind)).filter(F.col(name) <= n)


def top_by_value(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    n: int = 1,
    kind: str = "rank",
    name: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """As :func:`top`, but no task holds the rows that tie: the windows see distinct values only."""
    by = list(by)
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*by).orderBy(order)
    values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    best = values.withColumn(name, F.dense_rank().over(w).cast("long")).filter(F.col(name) <= n)
    if kind == "rank":
        before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))
        best = best.withColumn(name, F.coalesce(before, F.lit(0)) + 1).filter(F.col(name) <= n)
    best = best.drop("__n")
    return join_null_safe(df, best, [*by, value])


def _value_positions(df: DataFrame, by: list[str], value: str, descending: bool) -> DataFrame:
    """One row per (by, value): rows in it, rows before it, distinct values before it.

    ``by`` has few groups, each of any size, so every group is cut into slices of its value range.
    """
    values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn(SLICE, number_slice(value))

    def ordered(column):
        return F.col(column).desc() if descending else F.col(column).asc()

    before = (Window.unboundedPreceding, -1)
    local = Window.partitionBy(*by, SLICE).orderBy(ordered(value))
    across = Window.partitionBy(*by).orderBy(ordered(SLICE)).rowsBetween(*before)
    zero = F.lit(0)
    carry = (
        values.groupBy(*by, SLICE)
        .agg(F.sum("__n").alias("__slice_rows"), F.count("__n").alias("__slice_values"))
        .select(
            *by,
            SLICE,
            F.coalesce(F.sum("__slice_rows").over(across), zero).alias("__rows_carry"),
            F.coalesce(F.sum("__slice_values").over(across), zero).alias("__values_carry"),
        )
    )
    placed = values.withColumn(
        "__rows_local", F.coalesce(F.sum("__n").over(local.rowsBetween(*before)), zero)
    ).withColumn("__values_local", F.row_number().over(local) - 1)
    return join_null_safe(placed, carry, [*by, SLICE]).select(
        *by,
        value,
        "__n",
        (F.col("__rows_local") + F.col("__rows_carry")).alias("__rows_before"),
        (F.col("__values_local") + F.col("__values_carry")).alias("__values_before"),
    )


def _with_positions(df: DataFrame, by: Sequence[str], value: str, descending: bool) -> DataFrame:
    """Rows joined with their value's position. An empty ``by`` means one group over everything."""
    return join_null_safe(df, _value_positions(df, list(by), value, descending), [*by, value])


def ranked(
    df: DataFrame, by: Sequence[str], value: str, kind: str = "rank", name: str = "rank", descending: bool = True
) -> DataFrame:
    """Add RANK or DENSE_RANK of ``value`` to every row; no group and no tie is held in one task."""
    before = {"rank": "__rows_before", "dense": "__values_before"}[kind]
    joined = _with_positions(df, by, value, descending)
    return joined.withColumn(name, (F.col(before) + 1).cast("long")).select(*df.columns, name)


def _number_ties(df: DataFrame, keys: list[str], identifier: str) -> DataFrame:
    """Position of each row among the ``__n`` rows of its key, ordered by a unique identifier.

    Ties are cut into ranges of the identifier, of a bounded number whether ids are dense or hashed.
    """
    rows = df.withColumn(SLICE, number_slice(identifier))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("__slice_rows"))
        .select(*keys, SLICE, F.sum("__slice_rows").over(before).alias("__carry"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(identifier))
    return (
        join_null_safe(rows.withColumn("__tie", local), carry, [*keys, SLICE])
        .withColumn("__tie", F.col("__tie") + F.coalesce("__carry", F.lit(0)))
        .drop(SLICE, "__carry")
    )


def numbered(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    identifier: str,
    name: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """ROW_NUMBER by ``value``, ties in the order of a unique ``identifier``."""
    joined = _with_positions(df, by, value, descending)
    return (
        _number_ties(joined, [*by, value], identifier)
        .withColumn(name, (F.col("__rows_before") + F.col("__tie")).cast("long"))
        .drop("__n", "__rows_before", "__values_before", "__tie")
    )


def _tile(position: Column, total: Column, tiles: int) -> Column:
    """NTILE of a 1-based position: the first ``total % tiles`` tiles are one row longer."""
    size = F.floor(total / tiles)
    longer = total % tiles
    in_longer = longer * (size + 1)
    return F.when(
        position <= in_longer, F.floor((position - 1) / (size + 1)) + 1
    ).otherwise(F.floor((position - 1 - in_longer) / F.greatest(size, F.lit(1))) + longer + 1)


def tiled(
    df: DataFrame, value: str, identifier: str, tiles: int, name: str, descending: bool = True
) -> DataFrame:
    """NTILE over the whole table: ties in the order of ``identifier``, then of any.

    Rows are numbered inside even ranges of (value, identifier), so a value that very many rows share is cut too. A
    row's place is its number and the rows of the ranges before, which are one count for each range. The result comes in the
    order of value and identifier.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(identifier).asc()]
    rows = ranged(df, [], order)
    within = Window.partitionBy(RANGE)
    numbers = rows.withColumn("__number", F.row_number().over(within.orderBy(*order)))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = border_keys(rows, [], {}).withColumns({
        "__before": F.coalesce(F.sum(ROWS).over(before), F.lit(0)),
        "__total": F.sum(ROWS).over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    placed = with_borders(numbers, sizes, [], within, ["__before", "__total"])
    tile = _tile(F.col("__before") + F.col("__number"), F.col("__total"), tiles).cast("long")
    return placed.withColumn(name, tile).select(*df.columns, name)


def first_against_second(
    df: DataFrame, by: Sequence[str], value: str, first: dict[str, str], second: dict[str, str], difference: str
) -> DataFrame:
    """Best rows per group beside the runners-up; ties on either side multiply rows.

    ``first`` and ``second`` map input columns to output names. A group without a runner-up stays.
    The ranks are part of the join key, so it is an equi-join even over a single group.
    """
    by = list(by)
    best = top_by_value(df, by, value, 2, "dense", "__rank")
    a = best.filter(F.col("__rank") == 1).select(*by, "__rank", *[F.col(c).alias(n) for c, n in first.items()])
    above = (F.col("__rank") - 1).alias("__rank")
    b = best.select(*by, above, *[F.col(c).alias(n) for c, n in second.items()])
    pairs = a.join(b, [*by, "__rank"], "left").drop("__rank")
    return pairs.withColumn(difference, F.col(first[value]) - F.col(second[value]))


def first_and_second(
    df: DataFrame, by: Sequence[str], value: str, identifier: str, first: dict[str, str], second: dict[str, str], difference: str
) -> DataFrame:
    """One row per group: its best row beside the next, equal values in the order of ``identifier``."""
    by = list(by)
    best = top(df, by, [F.col(value).desc(), F.col(identifier).asc()], 2, "row", "__rank")
    sides = [F.max(F.when(F.col("__rank") == k, F.col(c))).alias(n) for k, names in ((1, first), (2, second)) for c, n in names.items()]
    return best.groupBy(*by).agg(*sides).withColumn(difference, F.col(first[value]) - F.col(second[value]))
