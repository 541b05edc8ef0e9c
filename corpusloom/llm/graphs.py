"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node on an edge.

    edges: a, b (any direction, repeats allowed).  In a round every node moves to its smallest
    neighbour if that is smaller, and on to that one's, edges follow and loops go; the local minima
    stay.  A round leaves at most the independent set of minima, or half of a path.  The moves are composed at the end.  Only
    minima are taken per node, never lists of neighbours, so a hub costs one partial aggregate.
    """
    ends = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")))
        onward = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
        move = stored(move.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        moves.append(move)
        ends = (
            ends.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        ends = stored(ends)
    if not moves:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = moves[0].withColumnRenamed("to", "component")
    for move in moves[1:]:
        step = move.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
