"""Nearest neighbours by largest inner product with shifted space-filling curves.

Vectors are lifted so that the largest inner product is the nearest point (an extra coordinate makes
all lengths equal), projected to ``DIMS`` directions, shifted and numbered along a Hilbert curve, once
per curve with directions orthogonal to the other curves' and another shift.  Each curve's keys are cut at
their quantiles into segments, and neighbouring segments are a task.  A query is compared with the segments of a window
around its own on every curve; the windows' best are merged and ranked by exact inner product.  Both sides of a
comparison are bounded: where more than about ``task_queries`` queries reach a task, they are dealt to several groups by
a hash, and its vectors go to each of them.

The window is a fraction of the curve (and as many rows as a query asks for).  On vectors without structure
(independent directions, inner products near zero) no projection keeps neighbours close, so the
fraction must be large to reach a recall of 0.9; on clustered vectors a far smaller one does.  The fraction
keeps recall alike at every number of vectors.

Equal vectors are one point, which carries its k + 1 smallest ids: no more can be among the k nearest
of a query.  They have equal keys, so a hot vector is one short run of a segment, and a query vector is
compared once however many rows ask it.  Vectors travel packed in matrices per segment, in their own
precision.

Defined results: vectors that are null, zero, of another than the most frequent length (on a tie, the
smallest) or hold null or non-finite components take no part, nor does a null vec_id; rows with equal
vec_id count as one and never find themselves (if their vectors differ, the id is found by its best and
asks with one of them, the same in every run); ties go to the smaller vec_id; fewer than k candidates
give all found; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

CURVES = 5
FRACTION = 0.30
DIMS, BITS = 6, 8
TIE_BITS = 14
#: Segments of a curve, at least; rows and queries of a group, about; rows dealt at once; bytes merged at once.
SEGMENTS = 64
TASK_ROWS = 1 << 16
TASK_QUERIES = 1 << 14
DEAL_ROWS = 1 << 15
SHARE_BYTES = 1 << 25


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cells (unsigned numbers of ``bits`` bits)."""
    x = cells.astype(np.uint64).copy()
    n, d = x.shape
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[:, d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= t[:, None]
    key = np.zeros(n, dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


class Curves:
    """Projections and shifts of all curves; ``cuts`` are the bounds of the segments on each."""

    def __init__(self, dim: int, longest: float, curves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = dim + 1
        turns = [np.linalg.qr(rng.normal(size=(wide, wide)))[0] for _ in range(-(-curves * DIMS // wide))]
        every = np.concatenate(turns, axis=1)[:, : curves * DIMS]
        self.longest = longest
        self.directions = every.reshape(wide, curves, DIMS).transpose(1, 0, 2)
        self.shifts = rng.uniform(0, 1, size=(curves, DIMS))
        self.cuts: list[np.ndarray] = []

    def keys(self, marks: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(curves, rows) keys as non-negative int64; ``marks`` (a hash of the vector) order equal cells."""
        x = x.astype(np.float64)
        gap = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        lifted = np.concatenate([x, gap[:, None]], axis=1) / self.longest
        tie = marks.view(np.uint64) >> np.uint64(64 - TIE_BITS)
        out = []
        for a, s in zip(self.directions, self.shifts, strict=True):
            unit = (lifted @ a) * np.sqrt(a.shape[0]) / 6 + 0.25 + s / 2  # three deviations, and room for the shift
            cells = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            out.append(((hilbert_keys(cells, BITS) << np.uint64(TIE_BITS)) | tie).astype(np.int64))
        return np.stack(out)


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, mark and vectors of a batch."""
    n = batch.num_rows
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat.reshape(n, -1) if n else flat.reshape(0, 1)


def points(ids: np.ndarray, marks: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k + 1 smallest ids of every distinct vector."""
    order = np.lexsort((ids, marks))
    m, i, v = marks[order], ids[order], x[order]
    same = (m[1:] == m[:-1]) & (v[1:] == v[:-1]).all(axis=1)
    fresh = np.concatenate([[True], ~same | (i[1:] != i[:-1])])[: len(order)]
    order, same = order[fresh], np.concatenate([[False], same])[: len(order)][fresh]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(same, 0, at)) <= k]


def best_of(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best found by each of ``asked``, each id once by its best score, ties to the
    smaller id; in order of asked, then rank."""
    order = np.lexsort((-scores, ids, asked))
    q, i = asked[order], ids[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])[: len(order)]]
    order = order[np.lexsort((ids[order], -scores[order], asked[order]))]
    q, at = asked[order], np.arange(len(order))
    first = np.concatenate([[True], q[1:] != q[:-1]])[: len(order)]
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def _runs(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a sorted array."""
    cut = np.flatnonzero(asked[1:] != asked[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(asked)]])


_PACKED = pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("seg", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("mark", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, curves: int = CURVES, fraction: float = FRACTION, task_rows: int = TASK_ROWS, task_queries: int = TASK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score.  vectors: vec_id, embedding; is_query is evaluated on them."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    width = np.float32 if single else np.float64
    held_as = "array<float>" if single else "array<double>"
    clean = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held_as).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("ask")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    shapes = clean.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("m"), F.count_if("ask").alias("q"), F.max(length).alias("longest"))
    shape = shapes.orderBy(F.desc("m"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("embedding") == shape["d"])
    clean = clean.select("vec_id", F.xxhash64("embedding").alias("mark"), "embedding", "ask")
    model = Curves(shape["d"], shape["longest"], curves)
    m = shape["m"]
    n_seg = max(SEGMENTS, -(-m // task_rows))
    wide = min(n_seg, -(-max(math.ceil(fraction * m), k + 1) * n_seg // m) + 1)
    per = max(1, min(wide // 2, task_rows * n_seg // m))  # segments in a task
    n_task = -(-n_seg // per)
    reach = min(n_task, (wide - 1) // per + 2)  # tasks of a query on a curve, at most
    blocks = max(1, -(-shape["q"] * min(n_seg, wide + per) // (n_seg * task_queries)))

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, x = _columns(batch)
            some = points(ids, marks, x, k)
            keys = model.keys(marks[some], x[some])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in keys], names=[f"k{i}" for i in range(curves)])

    keys = clean.select("vec_id", "mark", "embedding").mapInArrow(key_rows, ", ".join(f"k{i} long" for i in range(curves)))
    at = [i / n_seg for i in range(1, n_seg)]
    cuts = keys.agg(*[F.percentile_approx(f"k{i}", at, max(10_000, 20 * n_seg)).alias(f"k{i}") for i in range(curves)]).first()
    model.cuts = [np.array(c, dtype=np.int64) for c in cuts]
    held = spark.sparkContext.broadcast(model)

    def dealt(ids: np.ndarray, marks: np.ndarray, x: np.ndarray, ask: np.ndarray) -> pa.RecordBatch:
        some = points(ids, marks, x, k)
        asks = np.flatnonzero(ask)
        asks = asks[points(marks[asks], marks[asks], x[asks], 0)]
        seg_of = lambda rows: [np.searchsorted(c, keys, side="right") for c, keys in zip(held.value.cuts, held.value.keys(marks[rows], x[rows]), strict=True)]
        out = []
        for kind, rows, name in ((0, some, ids), (1, asks, marks)):
            for c, seg in enumerate(seg_of(rows)):
                if kind == 0:
                    first = last = seg // per
                else:
                    seg = np.clip(seg - wide // 2, 0, n_seg - wide)  # where the window starts
                    first, last = seg // per, (seg + wide - 1) // per
                for t in range(int(first.min(initial=n_task)), int(last.max(initial=-1)) + 1):
                    mine = np.flatnonzero((first <= t) & (t <= last))
                    block = marks[rows[mine]] % blocks if kind else None  # vectors go to all blocks of queries
                    for b in range(blocks):
                        part = mine if block is None else mine[block == b]
                        if len(part):
                            r = rows[part]
                            out.append(((c * n_task + t) * blocks + b, kind, seg[part].astype(np.int32).tobytes(), name[r].tobytes(), x[r].astype(width).tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * len(_PACKED)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        for batch in batches:
            gathered.append((*_columns(batch), np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)))
            if sum(len(g[0]) for g in gathered) >= DEAL_ROWS:
                yield dealt(*(np.concatenate(c) for c in zip(*gathered, strict=True)))
                gathered = []
        if gathered:
            yield dealt(*(np.concatenate(c) for c in zip(*gathered, strict=True)))

    def compare(t: pa.Table) -> pa.Table:
        base = (t["task"][0].as_py() // blocks % n_task) * per

        def side(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            part = t.filter(pa.array(t["kind"].to_numpy() == kind))
            names = np.frombuffer(b"".join(part["ids"].to_pylist()), np.int64)
            x = np.frombuffer(b"".join(part["vectors"].to_pylist()), width).reshape(len(names), -1) if len(names) else np.zeros((0, shape["d"]), width)
            return np.frombuffer(b"".join(part["seg"].to_pylist()), np.int32), names, x.astype(np.float64)

        seg, ids, x = side(0)
        start, marks, q = side(1)
        if len(ids):
            order = points(ids, np.ascontiguousarray(x).view(np.int64).sum(axis=1), x, k)  # copies dealt by different tasks
            order = order[np.lexsort((ids[order], seg[order]))]
            seg, ids, x = seg[order], ids[order], x[order]
        some = np.sort(points(marks, marks, q, 0))
        some = some[np.argsort(start[some], kind="stable")]
        start, marks, q = start[some], marks[some], q[some]
        bound = np.searchsorted(seg, np.arange(base, base + per + 1))  # rows of each segment here
        largest = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
        out: list[list] = [[], [], []]
        for a, b in zip(*_runs(start), strict=True) if len(start) else ():
            lo = bound[min(max(int(start[a]) - base, 0), per)]
            hi = bound[min(max(int(start[a]) + wide - base, 0), per)]
            y = x[lo:hi]
            for c in range(a, b if hi > lo else a, 128):
                ask = q[c : min(c + 128, b)]
                s = ask @ y.T
                if hi - lo > k + 1:
                    edge = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)]
                    # products summed in another order differ by rounding only; the margin holds all ties
                    edge = edge - 1e-12 * len(y[0]) * largest * np.sqrt((ask * ask).sum(axis=1))
                    near, row = np.nonzero(s >= edge[:, None])
                else:
                    near, row = (v.ravel() for v in np.indices(s.shape))
                # einsum sums every pair in the same order, so equal vectors get equal scores
                exact = np.einsum("nd,nd->n", ask[near], y[row])
                best = best_of(near, ids[lo + row], exact, k + 1)
                for i, j in zip(*_runs(near[best]), strict=True):
                    mine = best[i:j]
                    out[0].append(int(marks[c + near[mine[0]]]))
                    out[1].append(ids[lo + row[mine]].tobytes())
                    out[2].append(exact[mine].tobytes())
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    def merge(t: pa.Table) -> pa.Table:
        parts = t["ids"].to_pylist()
        asked = np.repeat(t["mark"].to_numpy(), [len(p) // 8 for p in parts])
        ids = np.frombuffer(b"".join(parts), np.int64)
        scores = np.frombuffer(b"".join(t["scores"].to_pylist()), np.float64)
        best = best_of(asked, ids, scores, k + 1)
        asked, ids, scores = asked[best], ids[best], scores[best]
        first, last = _runs(asked) if len(asked) else (np.zeros(0, int), np.zeros(0, int))
        offsets = pa.array(np.concatenate([first, last[-1:]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids, scores)] if len(asked) else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))]
        return pa.Table.from_arrays([pa.array(asked[first], pa.int64()), *lists], names=["mark", "ids", "scores"])

    packed = clean.mapInArrow(deal, "task long, kind int, seg binary, ids binary, vectors binary")
    found = packed.groupBy("task").applyInArrow(compare, "mark long, ids binary, scores binary")
    shares = max(8, shape["q"] * 48 * (k + 1) * curves * reach // SHARE_BYTES)
    found = found.withColumn("share", F.pmod(F.xxhash64("mark"), F.lit(shares)))
    best = found.groupBy("share").applyInArrow(merge, "mark long, ids array<long>, scores array<double>")
    asked = clean.where("ask").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("mark").alias("mark"))
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("query_id"))
    ranked = asked.join(best, "mark").select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "p"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
