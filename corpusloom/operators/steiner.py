"""Joining a query's terminals by a cheap tree, and growing it, for all queries at once.

Regions of the terminals grow by relaxing edges from all of them together; two regions that touch are joined at best by
one border edge, and a minimum spanning tree over the regions (each component takes its cheapest border, again and again) picks
the borders whose paths make the tree.  Its cost is at most twice the cheapest tree's.  Ties go to the smaller names, so reruns agree.

``connect`` streams queries of up to ``MOST_EDGES`` edges through tasks, one at a time; larger ones are joins on (query, node), so that no
such query's graph is one group.  Both follow the same rules.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Checkpoint = Callable[[DataFrame], DataFrame]


def regions(terminals: DataFrame, edges: DataFrame, *, checkpoint: Checkpoint) -> DataFrame:
    """query_id, node_id, near (dist, owner, before): the nearest terminal of each node reached and the node before it."""
    kind = F.struct(F.lit(0.0).alias("dist"), F.col("node_id").alias("owner"), F.lit(None).cast("string").alias("before"))
    found = checkpoint(terminals.select("query_id", "node_id", kind.alias("near")).distinct())
    edge = found
    while not edge.isEmpty():
        step = edge.join(edges.withColumnRenamed("a", "node_id"), ["query_id", "node_id"])
        step = step.select("query_id", F.col("b").alias("node_id"), F.struct((F.col("near.dist") + F.col("cost")).alias("dist"), F.col("near.owner").alias("owner"), F.col("node_id").alias("before")).alias("near"))
        new = step.groupBy("query_id", "node_id").agg(F.min("near").alias("new"))
        both = checkpoint(found.join(new, ["query_id", "node_id"], "full"))
        # a null before is the smallest, so a terminal keeps its own region; equal distances go to the smaller owner
        closer = F.col("near").isNull() | (F.struct("new.dist", "new.owner") < F.struct("near.dist", "near.owner"))
        edge = both.where(closer & F.col("new").isNotNull()).select("query_id", "node_id", F.col("new").alias("near"))
        found = both.select("query_id", "node_id", F.when(closer & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("near")).alias("near"))
    return found


def spanning(borders: DataFrame, *, checkpoint: Checkpoint) -> DataFrame:
    """query_id, border: the borders of a minimum spanning forest over regions.

    borders: query_id, x, y (owners, x < y), border (a struct whose order is that of costs, no two alike in a query).  Each
    round joins every component along its cheapest border; the two that chose each other keep the smaller name.
    """
    left = checkpoint(borders)
    chosen = left.select("query_id", "border").limit(0)
    while not left.isEmpty():
        ends = left.select("query_id", F.col("x").alias("c"), F.struct("border", F.col("y").alias("to")).alias("best"))
        ends = ends.unionByName(left.select("query_id", F.col("y").alias("c"), F.struct("border", F.col("x").alias("to")).alias("best")))
        best = checkpoint(ends.groupBy("query_id", "c").agg(F.min("best").alias("best")).select("query_id", "c", F.col("best.border").alias("border"), F.col("best.to").alias("to")))
        chosen = checkpoint(chosen.unionByName(best.select("query_id", "border").distinct()))
        back = best.select("query_id", F.col("c").alias("to"), F.col("to").alias("back"))
        root = best.join(back, ["query_id", "to"], "left").select("query_id", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        root = checkpoint(root)
        while True:  # each name to that of the end of its chain, twice as far a round
            on = root.select("query_id", F.col("c").alias("to"), F.col("to").alias("far"))
            further = checkpoint(root.join(on, ["query_id", "to"], "left").select("query_id", "c", F.coalesce("far", "to").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            root = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        named = left.join(root.toDF("query_id", "x", "nx"), ["query_id", "x"]).join(root.toDF("query_id", "y", "ny"), ["query_id", "y"]).where("nx <> ny")
        lower, upper = F.least("nx", "ny"), F.greatest("nx", "ny")
        left = checkpoint(named.groupBy("query_id", lower.alias("x"), upper.alias("y")).agg(F.min("border").alias("border")))
    return chosen


def tree(terminals: DataFrame, edges: DataFrame, *, checkpoint: Checkpoint) -> DataFrame:
    """query_id, node_id: the terminals that have edges and the nodes of the paths that join them.

    terminals: query_id, node_id; edges: query_id, a, b, cost above 0, both directions.
    """
    edges = checkpoint(edges.groupBy("query_id", "a", "b").agg(F.min("cost").alias("cost")))
    linked = edges.select("query_id", F.col("a").alias("node_id")).distinct()
    ends = checkpoint(terminals.select("query_id", "node_id").distinct().join(linked, ["query_id", "node_id"], "left_semi"))
    near = checkpoint(regions(ends, edges, checkpoint=checkpoint))
    side = lambda c: near.select("query_id", F.col("node_id").alias(c), F.col("near.dist").alias(f"d{c}"), F.col("near.owner").alias(f"o{c}"))
    met = edges.where("a < b").join(side("a"), ["query_id", "a"]).join(side("b"), ["query_id", "b"]).where("oa <> ob")
    border = F.struct((F.col("da") + F.col("cost") + F.col("db")).alias("cost"), F.least("oa", "ob").alias("x"), F.greatest("oa", "ob").alias("y"), "a", "b")
    borders = met.groupBy("query_id", F.least("oa", "ob").alias("x"), F.greatest("oa", "ob").alias("y")).agg(F.min(border).alias("border"))
    picked = spanning(borders, checkpoint=checkpoint)
    walk = checkpoint(picked.select("query_id", F.explode(F.array("border.a", "border.b")).alias("node_id")).distinct())
    seen = ends.unionByName(walk).distinct()
    before = near.select("query_id", "node_id", F.col("near.before").alias("before")).where("before is not null")
    while not walk.isEmpty():
        back = walk.join(before, ["query_id", "node_id"]).select("query_id", F.col("before").alias("node_id")).distinct()
        walk = checkpoint(back.join(seen, ["query_id", "node_id"], "left_anti"))
        seen = checkpoint(seen.unionByName(walk))
    return seen


def _near(ends: set[str], cost: dict[str, dict[str, float]]) -> dict[str, tuple]:
    """``regions`` of one query: node -> (dist, owner, before)."""
    found = {n: (0.0, n, None) for n in ends}
    edge = found
    while edge:
        new: dict[str, tuple] = {}
        for a, (dist, owner, _) in edge.items():
            for b, c in cost[a].items():
                step = (dist + c, owner, a)
                if b not in new or step < new[b]:
                    new[b] = step
        edge = {b: step for b, step in new.items() if b not in found or step[:2] < found[b][:2]}
        found = found | edge
    return found


def _joined(terminals: set[str], edges: list[tuple], ranks: list[tuple], grow: int) -> set[str]:
    """``connect`` of one query.  edges: a, b, cost; ranks: node, x.  The order of borders is total, so its spanning forest is one only."""
    cost: dict[str, dict[str, float]] = {}
    for a, b, c in edges:
        own = cost.setdefault(a, {})
        own[b] = min(c, own.get(b, c))
    ends = {n for n in terminals if n in cost}
    near = _near(ends, cost)
    borders: dict[tuple, tuple] = {}
    for a, own in cost.items():
        for b, c in own.items():
            if a < b and a in near and b in near and near[a][1] != near[b][1]:
                pair = tuple(sorted((near[a][1], near[b][1])))
                border = (near[a][0] + c + near[b][0], *pair, a, b)
                borders[pair] = min(border, borders.get(pair, border))
    up = {n: n for n in ends}

    def root(n: str) -> str:
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    inside = set(ends)
    for _, x, y, a, b in sorted(borders.values()):
        if root(x) != root(y):
            up[root(x)] = root(y)
            for n in (a, b):
                while n is not None and n not in inside:
                    inside.add(n)
                    n = near[n][2]
    best: dict[str, float] = {}
    for n, x in ranks:
        if x > 0:
            best[n] = max(x, best.get(n, x))
    offers: dict[str, tuple] = {}
    last: set[str] = inside.copy()
    for _ in range(grow):
        for a in last:
            for b, c in cost.get(a, {}).items():
                if b in best and b not in inside:
                    offer = (-best[b] / max(c, 1e-6), b)
                    offers[b] = min(offer, offers.get(b, offer))
        if not offers:
            break
        n = min(offers.values())[1]
        del offers[n]
        inside.add(n)
        last = {n}
    return inside


#: Edges of a query, both directions, up to which its graph is held in a task.
MOST_EDGES = 1 << 18


def _connect_streamed(terminals: DataFrame, edges: DataFrame, ranks: DataFrame, grow: int) -> DataFrame:
    """``connect`` of queries whose graphs fit into a task, which holds one at a time."""
    none = F.lit(None).cast("string")
    rows = edges.select("query_id", F.lit(0).alias("kind"), "a", "b", F.col("cost").cast("double").alias("v"))
    rows = rows.unionByName(terminals.select("query_id", F.lit(1).alias("kind"), F.col("node_id").alias("a"), none.alias("b"), F.lit(0.0).alias("v")))
    rows = rows.unionByName(ranks.select("query_id", F.lit(2).alias("kind"), F.col("node_id").alias("a"), none.alias("b"), F.col("x").cast("double").alias("v")))
    rows = rows.where("query_id is not null and a is not null and v is not null and (kind <> 0 or b is not null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def lines() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("query_id").type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        who, names = [], []
        for q, own in itertools.groupby(lines(), lambda r: r[0]):
            parts: tuple[list, list, list] = ([], [], [])
            for _, k, a, b, v in own:
                parts[k].append((a, b, v))
            if parts[1]:
                found = _joined({a for a, _, _ in parts[1]}, parts[0], [(a, v) for a, _, v in parts[2]], grow)
                who += [q] * len(found)
                names += found
            if len(who) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(names, pa.string())], names=["query_id", "node_id"])
                who, names = [], []
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(names, pa.string())], names=["query_id", "node_id"])

    made = f"query_id {edges.schema['query_id'].dataType.simpleString()}, node_id string"
    return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, made)


def connect(terminals: DataFrame, edges: DataFrame, ranks: DataFrame, *, checkpoint: Checkpoint, grow: int = 20, most: int = MOST_EDGES) -> DataFrame:
    """query_id, node_id: the tree, then ``grow`` times the neighbour of largest rank over edge cost, ties by name.

    ranks: query_id, node_id, x; a neighbour without positive rank never comes in.  Queries of more than ``most`` edges go by joins.
    """
    edges = checkpoint(edges)
    large = checkpoint(edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("query_id"))
    if large.isEmpty():
        return _connect_streamed(terminals, edges, ranks, grow)
    tables = terminals, edges, ranks
    small = _connect_streamed(*(t.join(large, "query_id", "left_anti") for t in tables), grow)
    return small.unionByName(_connect_joined(*(t.join(large, "query_id", "left_semi") for t in tables), checkpoint=checkpoint, grow=grow))


def _connect_joined(terminals: DataFrame, edges: DataFrame, ranks: DataFrame, *, checkpoint: Checkpoint, grow: int) -> DataFrame:
    """``connect`` by joins on (query, node)."""
    inside = tree(terminals, edges, checkpoint=checkpoint)
    gain = edges.join(ranks.select("query_id", F.col("node_id").alias("b"), "x").where("x > 0"), ["query_id", "b"])
    gain = gain.select("query_id", "a", "b", F.struct((-F.col("x") / F.greatest("cost", F.lit(1e-6))).alias("r"), F.col("b").alias("n")).alias("gain"))
    gain = checkpoint(gain.groupBy("query_id", "a", "b").agg(F.min("gain").alias("gain")))
    offers = None
    last = inside
    for _ in range(grow):
        # the best edge of each neighbour of the nodes that came in last, beside the offers that still stand
        new = last.select("query_id", F.col("node_id").alias("a")).join(gain, ["query_id", "a"]).select("query_id", "b", "gain")
        offers = new if offers is None else offers.unionByName(new)
        offers = offers.groupBy("query_id", "b").agg(F.min("gain").alias("gain"))
        offers = checkpoint(offers.join(inside.select("query_id", F.col("node_id").alias("b")), ["query_id", "b"], "left_anti"))
        last = checkpoint(offers.groupBy("query_id").agg(F.min("gain").alias("gain")).select("query_id", F.col("gain.n").alias("node_id")))
        if last.isEmpty():
            break
        inside = checkpoint(inside.unionByName(last))
    return inside
