"""PageRank of one restart vector by products of packed blocks.

Nodes are numbers.  65536 neighbouring numbers are a block of a vector, one row with its values packed; the edges between two
blocks are a tile, one row likewise.  A round joins tiles and blocks by block and adds what each block gets, so that an
edge costs a few bytes and no row of its own.  A task holds one tile, and adds one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.push import least_rounds, momentum

Checkpoint = Callable[[DataFrame], DataFrame]
_BITS = 16
_SIZE = 1 << _BITS


def _block(c: str) -> Column:
    return F.shiftright(c, _BITS)


def _local(c: str) -> Column:
    return F.col(c).bitwiseAND(_SIZE - 1)


def tiles(adj: DataFrame) -> DataFrame:
    """from_block, block, at, to, w: the packed edges of each pair of blocks that has some.  adj: a, b, w."""
    rows = adj.select(_block("a").alias("from_block"), _block("b").alias("block"), _local("a").alias("at"), _local("b").alias("to"), F.col("w").cast("double").alias("w"))

    def pack(t: pa.Table) -> pa.Table:
        cells = {"at": np.uint16, "to": np.uint16, "w": np.float64}
        packed = {c: [t[c].to_numpy().astype(kind).tobytes()] for c, kind in cells.items()}
        return pa.table({"from_block": t["from_block"][:1], "block": t["block"][:1]} | {c: pa.array(v, pa.binary()) for c, v in packed.items()})

    return rows.groupBy("from_block", "block").applyInArrow(pack, "from_block long, block long, at binary, to binary, w binary")


def product(edge_tiles: DataFrame, vector: DataFrame) -> DataFrame:
    """block, got: the sums of w times the vector's value over each node's incoming edges; blocks that get nothing are left out.

    vector: block, v.
    """
    met = edge_tiles.join(vector.select(F.col("block").alias("from_block"), "v"), "from_block").select("block", "at", "to", "w", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, to, w, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(w) * np.frombuffer(v)[np.frombuffer(at, np.uint16)]
                got = np.bincount(np.frombuffer(to, np.uint16), values)
                some = np.nonzero(got)[0]
                yield pa.RecordBatch.from_pydict({"block": [block], "to": [some.astype(np.uint16).tobytes()], "got": [got[some].tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        out = np.zeros(_SIZE)
        for to, got in zip(t["to"], t["got"], strict=True):
            out[np.frombuffer(to.as_py(), np.uint16)] += np.frombuffer(got.as_py())
        return pa.table({"block": t["block"][:1], "got": pa.array([out.tobytes()], pa.binary())})

    return met.mapInArrow(run, "block long, to binary, got binary").groupBy("block").applyInArrow(add, "block long, got binary")


_STATE = "block long, share binary, r binary, x binary, p binary, v binary, left double, mass double, lost double"


def _states(rows: DataFrame, make: Callable) -> DataFrame:
    """Rows of block, share, r, x, p and got by ``make``: (share, r, x, p, got) to (r, x, p, pushed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                share, r, x, p = (np.frombuffer(c) for c in row[1:5])
                got = np.zeros(len(share)) if row[5] is None else np.frombuffer(row[5])[: len(share)]
                r, x, p, pushed = make(share, r, x, p, got)
                packed = [c.tobytes() for c in (share, r, x, p, pushed * share)]
                sums = [float(np.abs(r).sum()), float(x.sum()), float(x[share == 0].sum())]
                names = [c.split()[0] for c in _STATE.split(", ")]
                yield pa.RecordBatch.from_pydict(dict(zip(names, ([c] for c in (row[0], *packed, *sums)), strict=True)))

    return rows.select("block", "share", "r", "x", "p", "got").mapInArrow(run, _STATE)


def _begin(adj: DataFrame, nodes: DataFrame, checkpoint: Checkpoint) -> tuple[DataFrame, DataFrame]:
    """Stored tiles and the blocks of nodes with the restart as r and the inverse weight of their edges (none: 0) as share."""
    held = checkpoint(tiles(adj))

    def pack(t: pa.Table) -> pa.Table:
        r = np.zeros(int(t["at"].to_numpy().max()) + 1)
        r[t["at"].to_numpy()] = t["r"].to_numpy()
        return pa.table({"block": t["block"][:1], "r": pa.array([r.tobytes()], pa.binary()), "v": pa.array([np.ones(len(r)).tobytes()], pa.binary())})

    rows = nodes.select(_block("node_id").alias("block"), _local("node_id").alias("at"), F.col("r").cast("double").alias("r"))
    blocks = checkpoint(rows.groupBy("block").applyInArrow(pack, "block long, r binary, v binary"))
    # both directions are edges, so what a node gets from ones is the weight of its own
    total = product(held, blocks.select("block", "v"))
    empty = blocks.join(total, "block", "left").select("block", F.col("r").alias("share"), "r", F.col("r").alias("x"), F.col("r").alias("p"), "got")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, r, got in zip(*(batch[c].to_pylist() for c in ("block", "r", "got")), strict=True):
                n = len(r) // 8
                t = np.zeros(n) if got is None else np.frombuffer(got)[:n]
                yield pa.RecordBatch.from_pydict({"block": [block], "share": [np.divide(1.0, t, out=np.zeros(n), where=t > 0).tobytes()], "r": [r]})

    return held, checkpoint(empty.mapInArrow(run, "block long, share binary, r binary"))


def _rows(state: DataFrame, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x)
                yield pa.RecordBatch.from_pydict({"node_id": (block << _BITS) + np.arange(len(x)), "x": x * scale})

    return state.select("block", "x").mapInArrow(run, "node_id long, x double")


def _next(held: DataFrame, state: DataFrame, make: Callable, checkpoint: Checkpoint) -> DataFrame:
    return checkpoint(_states(state.join(product(held, state.select("block", "v")), "block", "left"), make))


def converged(adj: DataFrame, nodes: DataFrame, *, checkpoint: Checkpoint, damping: float = 0.85, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """node_id, x: the ranks within the tolerance in sum, as ``push.forward_push`` certifies it, but every node is pushed.

    adj: a, b, w, both directions, between nodes; nodes: node_id (a number), r summing to 1.  Numbers that are no node's may come out.
    """
    held, base = _begin(adj, nodes, checkpoint)

    def first(share, r, x, p, got):
        r = (1 - damping) * r
        return r, np.zeros(len(r)), r, r

    same = [F.col("r").alias(c) for c in ("x", "p")]
    state = checkpoint(_states(base.select("*", *same, F.lit(None).cast("binary").alias("got")), first))
    check = least_rounds(damping, tolerance)
    for done, (keep, gain) in enumerate(momentum(damping, most), 1):

        def step(share, r, x, p, got, keep=keep, gain=gain):
            r, x = r - p + damping * got, x + p
            p = keep * p + gain * r
            return r, x, p, p

        state = _next(held, state, step, checkpoint)
        if done >= check and not done % 3:
            left = state.agg(F.sum("left")).first()[0]
            if left is None or left / (1 - damping) <= tolerance:
                break
    mass = state.agg(F.sum("mass")).first()[0]
    return _rows(state, 1 / mass if mass else 1.0)


def rounds(adj: DataFrame, nodes: DataFrame, n: int, *, checkpoint: Checkpoint, damping: float = 0.85) -> DataFrame:
    """node_id, x after ``n`` rounds from the restart, as ``paths.pagerank`` has it: mass of nodes without edges goes to the restart."""
    held, base = _begin(adj, nodes, checkpoint)
    same = [F.col("r").alias(c) for c in ("x", "p")]
    state = checkpoint(_states(base.select("*", *same, F.lit(None).cast("binary").alias("got")), lambda share, r, x, p, got: (r, r, r, r)))
    for _ in range(n):
        lost = state.agg(F.sum("lost")).first()[0] or 0.0

        def step(share, r, x, p, got, lost=lost):
            x = (1 - damping) * r + damping * got + damping * lost * r
            return r, x, x, x

        state = _next(held, state, step, checkpoint)
    return _rows(state, 1.0)
