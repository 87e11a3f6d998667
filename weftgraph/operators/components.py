"""Connected components by alternating large and small stars.

Each round is two grouped minima and two equi-joins over the edges; the number
of rounds is about log2 of a component's length, whatever its size.  A node with
most of the edges is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Scratch


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` of every node that an edge joins to another; component is its smallest node.

    Direction, repeated edges, loops and edges with a null end don't matter; a
    node without a neighbour doesn't come out, nor does an empty table's.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    u, v = F.greatest(left, right), F.least(left, right)
    state = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    state = scratch.write(state.select(u.alias("u"), v.alias("v")).distinct())
    before = _print(state)
    while before[0]:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Larger neighbours of a node move to its smallest neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Then a node and its smaller neighbours move to the smallest of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a")), F.struct(F.col("v").alias("a")))).alias("x"), "m")
        after = scratch.write(small.select(F.col("x.a").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        scratch.drop(state)
        state, now = after, _print(after)
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
