"""Connected components of a table of links, by alternating stars.

Every round links each node to the least neighbour twice over: first its larger neighbours (large star), then its
smaller ones and itself (small star). Both keep the components; the links end as stars around each component's
least node after a logarithmic number of rounds. A node's least neighbour is an aggregate with map-side combining,
and its neighbours are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmetrics.llm.shared import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links must run from the larger node to the smaller one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node, roots included, with the least node of its component.

    ``links`` has two columns of one type. Direction, repeats and links of a node to itself do not matter; links
    with a null are no links.
    """
    a, b = (F.col(c) for c in links.columns)
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    now, before = written(links, "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = written(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
