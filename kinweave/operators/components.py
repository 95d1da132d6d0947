"""Connected components by alternating star contraction on DataFrames.

Each round points every node's larger neighbours at the smallest node it knows
(large star), then does the same among its smaller neighbours (small star). The
number of edges never grows, and rounds grow with the logarithm of the graph,
not with its diameter. The root of a component is its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.skew import cut, cut_counted, drop_cut, join_counted


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    # Only the larger neighbours are rewritten, so edges can be cut before the join.
    up = both.where(F.col("v") > F.col("u"))
    return join_counted(up, near, ["u"], total=total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    # Every edge arrives with u > v.
    near = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hop = join_counted(edges, near, ["u"], total=total)
    moved = hop.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes with two edges, and nodes that are the end of one edge and the start of another."""
    starts = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    many = starts.where(F.col("n") > 1).select("u")
    ends = edges.select(F.col("v").alias("u")).distinct()
    return many.unionByName(ends.join(starts.select("u"), "u", "left_semi"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id on an edge; ids without edges are their own root and not listed.

    ``edges`` has two columns, ``a`` and ``b``, of texts or of numbers. One table of edges at
    a time lies in the shared folder; the last one stays, the result reads it.
    """
    e, total = cut_counted(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        # A round never adds edges, so the first count stays an upper bound.
        last, e = e, cut(_small_star(_large_star(e, total), total))
        drop_cut(last)
        if _unsettled(e).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
