"""Connected components of an edge table by contraction; narrow joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablelens.llm.common import release, saved


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b (long, a <> b). Returns node, component (its smallest node); nodes without edges are absent.

    In every round each node points to the least of itself and its neighbours, pointers are followed once more, and
    the edges are carried over to where their ends point; loops and repeats among them go. What remains is at most
    the edges between different trees of pointers, so that both many edges within a group and long chains shrink
    geometrically. Every table is written before it is joined, which lets Spark split the rows of a node that
    a third of the edges share. Repeated edges count once; without edges the result is empty.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    labels = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = saved(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up")), f"{name}-first")
        second = first.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        to = saved(first.join(second, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")), f"{name}-to")
        release(first)
        if labels is None:
            labels = saved(to.select("node", F.col("up").alias("component")), f"{name}-labels")
        else:
            step = to.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            old, labels = labels, saved(labels.join(step, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_u", "component").alias("component")), f"{name}-labels")
            release(old)
        of_a = saved(left.join(to, F.col("a") == F.col("node")).select(F.col("up").alias("a"), "b"), f"{name}-half")
        moved = of_a.join(to, F.col("b") == F.col("node")).select("a", F.col("up").alias("b")).where("a <> b")
        old, left = left, saved(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-left")
        release(old, of_a, to)
        if not left.limit(1).count():
            release(left)
            return labels
