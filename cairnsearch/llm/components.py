"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, store


def connected(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``links (a, b)``; a component is named by its smallest node.

    Alternating star contraction: every node hands its smallest neighbour to its larger, then to its
    smaller neighbours, until nothing changes; this takes about the logarithm of the longest chain
    in rounds. Each round is written to the shared folder; the driver sees two numbers. Nodes with a
    large share of all edges are joined without a shuffle (see :func:`join_hot`).
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges, before = store(edges, "components"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = store(_large_star(edges, now[0]), "components")
        edges = store(_small_star(edges, now[0]), "components")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", "n", F.least("u", "m").alias("m"))
    # a node's smaller neighbours are looked after by those neighbours
    near = join_hot(both.filter("v > u"), least, ["u"], "n", 2 * total)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = join_hot(edges, least, ["u"], "n", total).filter("v != m")
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
