"""Items that occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items of a basket that meet in one place; longer baskets are cut into blocks of about this many.
BLOCK = 1000
# Cells of the filter, a power of two: its array has a bit for each, half a megabyte.
CELLS = 2**22
# Tasks in which blocks meet, for each one that adds up their lists.
MEETING = 8
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def frequent_pairs(
    df: DataFrame, basket: str, item: str, min_support: int, block: int = BLOCK, cells: int | None = None, slices: int | None = None
) -> DataFrame:
    """Pairs (item_a < item_b) found in at least ``min_support`` baskets, with the exact count.

    Items below the support are dropped first: they cannot be part of a frequent pair. With ``cells`` (say CELLS),
    pairs are then counted by the cell they hash to, and only pairs whose cell reaches the support are counted
    themselves: a pair has no more baskets than its cell (after Park, Chen and Yu). That is a second pass over the
    pairs, which pays where the support is far above the pairs there are for each cell; the answer is the same.

    ``slices`` is the number of tasks in which blocks meet. A task holds the pairs of its own items, which are many
    times the items that it reads, and adaptive execution merges tasks by what they read. Pairs then go on as lists,
    one for an item and the partners it meets, which take a fraction of what a row for each pair does.
    """
    if slices and not cells:
        counts = _counted_by_lists(_placed(df, basket, item, min_support, block, slices), basket, item, slices)
    else:
        pairs = _pairs(df, basket, item, min_support, block, slices)
        if cells:
            pairs = pairs.filter(_in_cells(_full_cells(pairs, min_support, cells), cells))
        counts = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("support"))
    return counts.filter(F.col("support") >= min_support)


def _placed(df: DataFrame, basket: str, item: str, min_support: int, block: int, slices: int | None = None) -> DataFrame:
    """basket, __low, __high, __own, item, __weight: the items of each basket, once for each place in which they meet others.

    A basket of n items is cut by the items' hash into ceil(n / block) blocks, and every two of its blocks meet by
    themselves, so no task holds a whole basket. The weight is the power of two in the number of an item's baskets.
    """
    known = F.col(basket).isNotNull() & F.col(item).isNotNull()
    items = df.select(basket, item).filter(known).distinct()
    common = items.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_support)
    items = items.join(common.select(item, F.floor(F.log2("__n")).cast("int").alias("__weight")), item)
    sizes = items.groupBy(basket).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    cut = items.join(sizes, basket).withColumn("__own", F.pmod(F.xxhash64(item), F.col("__blocks")).cast("int"))
    every = cut.withColumn("__met", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("__own", "__met").alias("__low"), F.greatest("__own", "__met").alias("__high")
    placed = every.select(basket, low, high, "__own", item, "__weight")
    return placed.repartition(slices, basket, "__low", "__high") if slices else placed


def _pairs(df: DataFrame, basket: str, item: str, min_support: int, block: int, slices: int | None = None) -> DataFrame:
    """(item_a, item_b) for each basket that holds both."""
    placed = _placed(df, basket, item, min_support, block, slices).drop("__weight")
    a, b = (placed.withColumnsRenamed({item: f"item_{x}", "__own": f"__own_{x}"}) for x in "ab")
    met = a.join(b, [basket, "__low", "__high"])
    return met.filter((F.col("item_a") < F.col("item_b")) & _met_once(F.col("__own_a"), F.col("__own_b"))).select("item_a", "item_b")


def _met_once(own: Column, other: Column) -> Column:
    """Items of one block meet in its own place, not where it meets another block."""
    return (own != other) | (F.col("__low") == F.col("__high"))


def _counted_by_lists(placed: DataFrame, basket: str, item: str, slices: int) -> DataFrame:
    """item_a, item_b, support of rows dealt out by their place.

    In a place, each item gets a list of the others that are more frequent or, among equals, greater: in the place of
    one block those after it in its own sorted block, where two blocks meet those after it in the other. Lists of an
    item are brought together and counted. Few items are more frequent than a frequent one, so none has a large share.
    """
    kind, place = placed.select(item).dtypes[0][1], [basket, "__low", "__high"]
    known = F.struct("__weight", F.col(item).alias("item"))
    block = lambda where: F.sort_array(F.collect_list(F.when(where, known)))
    is_low, two = F.col("__own") == F.col("__low"), F.col("__low") != F.col("__high")
    blocks = placed.groupBy(*place).agg(block(is_low).alias("low"), block(~is_low).alias("high"))
    blocks = blocks.select(*place, *(F.struct(F.col(c).alias("order"), *_planes(F.col(c)["item"], kind)).alias(c) for c in ("low", "high")))
    theirs = F.when(is_low & two, F.col("high")).otherwise(F.col("low"))
    met = placed.join(blocks, place).select(F.col(item).alias("__key"), known.alias("__me"), two.alias("__two"), theirs.alias("__theirs"))
    order = F.col("__theirs")["order"]
    before = F.when(F.col("__two"), F.size(F.filter(order, lambda x: x < F.col("__me")))).otherwise(F.array_position(order["item"], F.col("__key")))
    after = met.withColumn("__before", before.cast("int")).filter(F.col("__before") < F.size(order))
    parts = [F.slice(F.col("__theirs")[c], F.col("__before") + 1, F.size(order)).alias(c) for c in _parts(kind)]
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slices // MEETING))
    lists = after.select("__key", *parts).repartition(tasks, "__key")
    rows = lists.select("*", F.posexplode("__first").alias("__at", "__v")).select("__key", _value(kind).alias("__other"))
    counts = rows.groupBy("__key", "__other").agg(F.count(F.lit(1)).alias("support"))
    return counts.select(F.least("__key", "__other").alias("item_a"), F.greatest("__key", "__other").alias("item_b"), "support")


def _parts(kind: str) -> list[str]:
    return ["__first", "__middle", "__high"] if kind in INTEGRAL else ["__first"]


def _planes(items: Column, kind: str) -> list[Column]:
    """An array's items as arrays: of whole numbers the lowest 16 bits, the next 8, and the rest if there is any.

    Numbers from 0 to 2 ** 24 so take three bytes, which a compressor of whole bytes does not reach from eight.
    """
    if kind not in INTEGRAL:
        return [items.alias("__first")]
    rest = lambda x: F.shiftright(x.cast("long"), 24)
    low = F.transform(items, lambda x: (x.cast("long").bitwiseAND(0xFFFF) - 0x8000).cast("smallint"))
    middle = F.transform(items, lambda x: (F.shiftright(x.cast("long"), 16).bitwiseAND(0xFF) - 0x80).cast("tinyint"))
    high = F.when(F.exists(items, lambda x: rest(x) != 0), F.transform(items, rest))
    return [c.alias(name) for c, name in zip((low, middle, high), _parts(kind))]


def _value(kind: str) -> Column:
    """The item at ``__at`` of the arrays of ``_planes``, of which ``__v`` is that of the first."""
    if kind not in INTEGRAL:
        return F.col("__v")
    middle, high = F.get("__middle", F.col("__at")).cast("long") + 0x80, F.coalesce(F.get("__high", F.col("__at")), F.lit(0).cast("long"))
    return (F.shiftleft(high, 24).bitwiseOR(F.shiftleft(middle, 16)).bitwiseOR(F.col("__v").cast("long") + 0x8000)).cast(kind)


def _cell(cells: int) -> Column:
    return F.xxhash64("item_a", "item_b").bitwiseAND(cells - 1)


def _full_cells(pairs: DataFrame, min_support: int, cells: int) -> Column:
    """The cells with at least so many pairs, as words of 64 bits in one array; a scalar of the plan."""
    full = pairs.groupBy(_cell(cells).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c") % 64).cast("int"))
    set_bits = full.select(F.floor(F.col("c") / 64).alias("w"), bit.alias("bits"))
    no_bits = pairs.sparkSession.range(max(cells // 64, 1)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(no_bits).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    listed = words.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("words"))  # one for each word
    return listed.select("words.bits").scalar()


def _in_cells(words: Column, cells: int) -> Column:
    cell = _cell(cells)
    word = F.get(words, F.floor(cell / 64).cast("int"))
    return F.getbit(word, (cell % 64).cast("int")) == 1
