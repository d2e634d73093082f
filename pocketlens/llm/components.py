"""Connected components of a graph given as an edge table, by alternating stars.

Each round links every larger neighbour of a node to the node's smallest neighbour
(large star), then every smaller neighbour and the node itself to its smallest one
(small star).  Rounds end when the edges no longer change; each edge then joins a
node with the smallest node of its component.  The edges of a round are written to
the shared scratch folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_counted

#: Rounds grow with the logarithm of the longest path; more than this means a fault.
MAX_ROUNDS = 64


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells one edge set from another: wrap-around sums of two hashes, taken from the write."""
    h = F.xxhash64("a", "b")
    counts = (F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"))
    edges, seen = materialise_counted(edges, "edges", *counts)
    return edges, (seen["n"], seen["high"], seen["low"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node reachable.

    Loops and rows with a null end are ignored, repeated and reversed edges count once.
    An empty edge table gives an empty result.  Nodes without an edge are not returned.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _written(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges, now = _written(_round(edges))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
