"""Connected components of a large graph by alternating stars.

Every round hangs larger neighbours on the smallest one (large star), then smaller ones on the
smallest of them (small star), until only stars are left; the number of rounds grows with the
logarithm of the longest path. Minima combine before the shuffle, and joins on a node with very many
links can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateledger.llm.tables import cut, sized


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. ``links``: a, b (no nulls; any order)."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = cut(edges), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        if now == seen or not now[0]:
            break
        seen = now
        edges = cut(small_star(large_star(sized(edges, now[0]), now[0]), now[0]))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    # u > v: the larger neighbours u of a centre v
    hung = edges.join(least, F.col("v") == F.col("c")).select("u", F.col("m").alias("v"))
    return sized(sized(hung, n).distinct(), n)


def small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    joined = edges.join(least, F.col("u") == F.col("c"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return sized(sized(moved, n).filter("u <> v").distinct(), n)
