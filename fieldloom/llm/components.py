"""Connected components of a graph held as a table of edges, by repeated contraction.

In a round each node hooks to the node of smallest rank among its neighbours and itself, where a rank
is a hash of the node and the round; hooks are followed once more, and the edges are rewritten
between the nodes reached. Ranks are new in each round, so even along a path a fixed share of the
nodes goes, and rounds grow with the logarithm of a component's size. Nothing is collected; each
round's tables go to reliable storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. edges: columns a and b, long; loops and repeats are allowed."""
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    found, turn = None, 0
    while not left.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("node"), ranked("b").alias("to")).union(left.select("b", ranked("a")))
        hooks = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", ranked("node"))["id"].alias("to"))
        twice = hooks.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moved = cut(hooks.join(twice, "to").select("node", "root"))
        a, b = moved.select(F.col("node").alias("a"), F.col("root").alias("ra")), moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fewer = cut(left.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct())
        drop(left)
        left = fewer
        if found is None:
            found = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            longer = cut(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            drop(found)
            drop(moved)
            found = longer
        turn += 1
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    smallest = found.groupBy("root").agg(F.min("node").alias("smallest"))
    return found.join(smallest, "root").select("node", F.col("smallest").alias("root"))
