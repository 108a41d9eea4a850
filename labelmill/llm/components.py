"""Connected components of a table of links, by alternating large and small stars.

Every round replaces links by shorter ones to smaller nodes: the large star
moves a node's larger neighbours to its smallest neighbour, the small star its
smaller ones.  Rounds are logarithmic in practice, each is two grouped minima
and joins, and every round's links are written to the shared folder.  A node
with very many links is met by partial minima and by a join that Spark can
split, as one side has a row per node only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import drop, keep


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    """Number and checksum of the links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with links; the component is its smallest node.

    ``links`` has two long columns; null ends, links of a node with itself and
    repeated links are left out.  No links: an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull())
    now = keep(pairs.filter("a > b").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = keep(_small_star(_large_star(now)), "links")
        reached, before = _state(after), state
        drop(now)
        now, state = after, reached
        if reached == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(roots.select("node", F.col("node").alias("component")))
