"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.operators.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: each node links its larger neighbours to its smallest neighbour.
    Small: each node links its smaller neighbours and itself to the smallest of them."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    both = around.join(least.hint("merge"), "u")  # staged ids are small as files, a broadcast of their rows is not
    if large:
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` that is not itself the smallest of its component.

    ``root`` is the smallest node reachable. Every round is written to the shared folder; rounds grow with the
    logarithm of the number of edges. No edges give no rows.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    was, mark = None, print_of(now)
    while mark[0] and mark != was:
        now = stage(_star(_star(now, large=True), large=False), "edges")
        was, mark = mark, print_of(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
