"""Connected components of a graph given as edges, by alternating stars.

Each round hangs every node's larger neighbours onto its smallest neighbour
(large star) and then its smaller neighbours onto the smallest of them (small
star), until nothing changes; every component is then a star around its smallest
node. Rounds grow with the logarithm of the graph's size. Minima are grouped
aggregates (combined before the shuffle) and written before they are joined, so
that both sides of the join are plain shuffles and a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hang(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b): every b, and a itself, onto the least of a and its b's."""
    least = staged(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long, any direction, repeats allowed -> (node, component) of every node
    that has an edge to another; ``component`` is the smallest node reachable."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = staged(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), f"{name}-edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-large")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), f"{name}-hung")
        edges = staged(_hang(large, name), f"{name}-round")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
