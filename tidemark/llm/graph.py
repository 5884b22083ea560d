"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached.

    Each step points nodes at the smallest neighbour; minima are pre-aggregated, and joins are between written tables, so
    that adaptive execution can split a node with very many links. The number of steps grows with the logarithm of the
    longest path. Nodes must not be null.
    """
    edges = ws.save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, step = _fingerprint(edges), 0
    while seen[0]:
        step += 1
        both = ws.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-both-{step}")
        least = ws.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least-{step}")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = ws.save(large, f"{name}-large-{step}")
        least2 = ws.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least2-{step}")
        small = large.join(least2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = ws.save(small.select("e.*").filter("a <> b").distinct(), f"{name}-{step}")
        ws.drop(f"{name}-both-{step}", f"{name}-least-{step}", f"{name}-large-{step}", f"{name}-least2-{step}")
        now = _fingerprint(new)
        edges, same = new, now == seen
        seen = now
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
