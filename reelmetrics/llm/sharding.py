"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Every row gets a global number 0 .. n-1, the permutation moves it to another number in that range, and shard and
slot are the remainder and quotient of the result. Both follow from the number alone, and lead back to it.

The permutation works on pairs (left, right) with left < a and right < b, where a = ceil(sqrt(n)) and
b = ceil(n / a). A round adds a keyed hash of one half to the other, modulo its range, which is a bijection
whatever the hash gives. Results outside 0 .. n-1 (fewer than a of a * b) are permuted again until they fall inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
# Rows are numbered in this many buckets, so the table of their offsets is that short.
BUCKETS = 8192
# Copies of one row are numbered in runs of this length; no task makes all copies of a row.
RUN = 4096
# Steps of the longest walk. Longer ones need WALK misses of chance 1 / sqrt(n) each; they raise an error.
WALK = 64


def _halves(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return a, F.ceil(n / a).cast("long")


def _divide(x: Column, by: Column) -> Column:
    return ((x - F.pmod(x, by)) / by).cast("long")


def _rounds(x: Column, a: Column, b: Column, seed: int, forward: bool) -> Column:
    left, right = _divide(x, b), F.pmod(x, b)
    for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        key = (F.lit(seed), F.lit(i))
        if i % 2 == 0:
            moved = F.pmod(F.xxhash64(right, *key), a)
            left = F.pmod(left + moved if forward else left - moved, a)
        else:
            moved = F.pmod(F.xxhash64(left, *key), b)
            right = F.pmod(right + moved if forward else right - moved, b)
    return left * b + right


def permuted(x: Column, n: Column, seed: int, forward: bool = True) -> Column:
    """The number that 0 <= x < n moves to, or with ``forward=False`` the one that moves to x."""
    a, b = _halves(n)

    def step(y: Column) -> Column:
        return _rounds(y, a, b, seed, forward)

    first = step(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, _: F.when(y < n, y).otherwise(step(y)))
    inside = F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    return F.when(first < n, first).otherwise(inside)


def numbered(df: DataFrame, keys: list[str], number: str = "row_no", total: str = "n_rows") -> DataFrame:
    """The key columns of every row with its global number, 0 .. n-1, and n.

    The order is that of a hash bucket of the keys, then of the keys, so it depends on the rows alone and not on
    their files or partitions. Rows that agree in all keys get neighbouring numbers. Nulls are ordinary values.
    """
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    once = once.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    sizes = once.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    all_before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(all_before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias(total),
    )
    before = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    # At most BUCKETS rows of three numbers, whatever the input.
    placed = placed.join(F.broadcast(offsets), "_bucket").withColumn("_start", F.col("_offset") + F.col("_before"))
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0), _divide(F.col("_copies") - 1, F.lit(RUN)))))
    runs = runs.repartition(*keys, "_run")
    last = F.least(F.col("_copies"), (F.col("_run") + 1) * RUN) - 1
    return runs.select(*keys, total, "_start", F.explode(F.sequence(F.col("_run") * RUN, last)).alias("_copy")).select(
        *keys, total, (F.col("_start") + F.col("_copy")).alias(number)
    )


def sharded(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """The key columns of every row with row_no, shard (0 .. shards-1) and slot (gapless from 0 in each shard).

    Shard sizes are at most one row apart. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    moved = numbered(df, keys).withColumn("_to", permuted(F.col("row_no"), F.col("n_rows"), seed))
    return moved.select(
        *keys,
        "row_no",
        F.pmod(F.col("_to"), F.lit(shards)).cast("int").alias("shard"),
        _divide(F.col("_to"), F.lit(shards).cast("long")).alias("slot"),
    )


def row_at(shard: Column, slot: Column, n: Column, shards: int, seed: int = 0) -> Column:
    """The global row number that lies in a shard's slot; NULL where there is none."""
    x = slot * shards + shard
    return F.when(x < n, permuted(x, n, seed, forward=False))


def text_columns(docs: DataFrame) -> DataFrame:
    """doc_id with the size (UTF-8 bytes and one more) and the CRC-32 of the text; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Shard and slot of every document under the law ``rows``: counts of shards differ by one at most.

    Null ids, null texts and repeated rows are ordinary rows: each row is dealt out once. Only doc_id and text are
    read; other columns are left out, whatever their names.
    """
    dealt = sharded(text_columns(docs), ["doc_id", "size", "text_crc32"], shards, seed)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
