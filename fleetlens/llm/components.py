"""Connected components of a graph given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node of its component.

    Each round links every node's larger neighbours to its least neighbour (large star), then
    every node's smaller neighbours too (small star), until every component is one star; that
    takes about log(longest path) rounds. Aggregates give a node's least neighbour, so the edges
    of a hot node are never in one task's memory. Edges are kept as a table after each round.
    Self-links are dropped. No edges give no rows.
    """
    now = stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        least = least.select(F.col("a").alias("_n"), F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("_n"))
        large = large.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a != b")
        # Every edge now goes from a larger node to a smaller one; the rest needs no more shuffle.
        large = large.repartition("a").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n")
        small = large.join(least, F.col("a") == F.col("_n"))
        ends = F.array(F.struct("b", "_m"), F.struct(F.col("_n").alias("b"), "_m"))
        pairs = small.select(F.explode(ends).alias("_e")).select(
            F.col("_e.b").alias("a"), F.col("_e._m").alias("b")
        )
        before, now = now, stored(pairs.filter("a != b").distinct(), "edges")
        discard(before)
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each edge leads from a node without other edges to one that is no such node, and down."""
    side = F.explode(
        F.array(
            F.struct(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")),
            F.struct(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")),
        )
    )
    nodes = edges.select(side.alias("_s"), (F.col("b") > F.col("a")).alias("_up"))
    nodes = nodes.groupBy("_s.n").agg(
        F.sum("_s.out").alias("out"), F.max("_s.into").alias("into"), F.max("_up").alias("up")
    )
    return not nodes.filter("out > 1 or (out = 1 and into = 1) or up").head(1)
