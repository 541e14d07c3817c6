"""Distributed connected components: alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialise, path_of


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b), the component being its smallest node.

    Null ends, loops and repeated edges don't count. Each round is two grouped minima and two joins on the node, written to
    the shared folder; no node's neighbours are ever gathered, so a hub costs rows, not memory.
    """
    now = materialise(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        before, now = now, materialise(low.select("a", F.col("m").alias("b")).union(moved).distinct(), "edges")
        drop(now.sparkSession, [path_of(before)])
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
