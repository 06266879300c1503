"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node of its component) for each node of edges (a, b).

    Large-star and small-star steps (Kiveris and others, "Connected Components
    in MapReduce and Beyond", 2014) turn the edges into stars around the
    smallest nodes, in a number of rounds that grows with the logarithm of the
    nodes. Each round is written to the shared folder, and the one before it goes. A node with many edges
    is reduced by partial minima before the shuffle; its join back is one that
    adaptive execution splits.

    Self-edges, repeated edges and edges with a null are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    current = written(pairs, "components")
    before = _fingerprint(current)
    while before[0]:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").unionByName(lowest.select("a", F.col("_m").alias("b"))).distinct()
        last, current = current, written(small, "components")
        discard(last)
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    stars = current.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
