"""Connected components of a table of links, by alternating large and small stars.

Every round is a minimum per node and an equality join, so no neighbour list is gathered anywhere
and a node with very many links stays a skewed join, which adaptive execution splits. Rounds are
written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.session import settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(turned)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(a, b)`` that is not the least of its component.

    ``component`` is the least node reachable. Loops and repeated links change nothing; an empty table
    gives an empty table.
    """
    edges = settle(links.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        edges = settle(_small(_large(edges).filter("a <> b").distinct()).filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(now)
