"""Connected components as joins and groupings, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from locusmill.llm.common import dropped, hot_join, saved


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, root being the smallest node of its component.

    Large-star and small-star steps in turn: each hangs a node's neighbours on the smallest of them, so
    the number of edges never grows and the rounds grow as the logarithm of the longest path. Loops,
    repeated edges and rows with a null end count for nothing; no edges give no rows. A node's smallest
    neighbour comes from a grouping that sums on the map side and is joined back by ``hot_join``, so that one node
    with very many neighbours is never gathered in a task. The table of a round goes when the next one is written.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.where("b > a"), least, ["a"], "n", 2 * mark[0])
        large = saved(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # now a > b in each edge: a hangs on b
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, ["a"], "n", 2 * mark[0])
        before = edges
        edges = saved(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        dropped(before)
        dropped(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
