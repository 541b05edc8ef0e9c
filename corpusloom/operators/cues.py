"""Navigation cues of graph objects: computed once for all objects as one long table.

cues: object_id, object_type, family (vertical, horizontal, semantic, provenance), pos, target_id,
locate, label, weight.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

FAMILIES = ("vertical", "horizontal", "semantic", "provenance")
#: What each ablation takes away; no_semantic_cues also empties the online recommendations.
VARIANTS: dict[str, tuple[str, ...]] = {
    "full": (),
    "no_vertical_cues": ("vertical",),
    "no_horizontal_cues": ("horizontal",),
    "no_semantic_cues": ("semantic",),
    "no_provenance_cues": ("provenance",),
    "no_offline": FAMILIES,
    "no_online": (),
}


def merge_locates(rows: DataFrame, key: str = "object_id", *, distinct: bool = False) -> DataFrame:
    """key, locate: ranges of one file that overlap or touch are joined; others are passed on.  distinct: no row comes twice.

    Gaps and islands: a range opens a new island if it starts after the running end plus one.
    """
    parsed = rows.select(key, "locate", T.parse_locate(F.col("locate")).alias("p"))
    parsed = parsed if distinct else parsed.distinct()
    good = parsed.where("p is not null").select(key, "p.*")
    order = Window.partitionBy(key, "file_name").orderBy("start_line", "end_line")
    ahead = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = good.withColumn("new", F.when(ahead.isNull() | (F.col("start_line") > ahead + 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(key, "file_name", "island").agg(F.min("start_line").alias("s"), F.max("end_line").alias("e"))
    return merged.select(key, T.locate(F.col("file_name"), F.col("s"), F.col("e")).alias("locate")).unionByName(parsed.where("p is null").select(key, "locate"))


def _cue(df: DataFrame, object_type: str, family: str, target, label, order: list, *, locate=None, weight=None) -> DataFrame:
    w = Window.partitionBy("object_id").orderBy(*order)
    none = F.lit(None).cast("string")
    return df.select(
        "object_id", F.lit(object_type).alias("object_type"), F.lit(family).alias("family"), (F.row_number().over(w) - 1).alias("pos"),
        (target if target is not None else none).alias("target_id"), (locate if locate is not None else none).alias("locate"),
        (label if label is not None else none).alias("label"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
    )


def chunk_cues(chunks: DataFrame, structure: DataFrame, summaries: DataFrame) -> DataFrame:
    """Parents by id, previous and next chunk, and the chunk's own locate."""
    ids = chunks.withColumn("object_id", F.concat(F.lit("chunk:"), "chunk_id"))
    parents = structure.join(summaries.select(F.col("node_id").alias("source"), "title"), "source", "left")
    up = parents.where(F.col("target").startswith("chunk:")).withColumn("object_id", F.col("target"))
    side = ids.select("object_id", F.explode(F.array(F.col("prev_chunk_id"), F.col("next_chunk_id"))).alias("t")).where("t is not null")
    own = T.locate(F.col("file_name"), F.col("start_line"), F.col("end_line"))
    return (
        _cue(up, "chunk", "vertical", F.col("source"), F.col("title"), ["source"])
        .unionByName(_cue(side, "chunk", "horizontal", F.concat(F.lit("chunk:"), "t"), None, ["t"]))
        .unionByName(_cue(ids, "chunk", "provenance", None, None, ["chunk_id"], locate=own))
    )


def entity_cues(entities: DataFrame, relations: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Neighbours by id, and merged locates.

    places: entity_id, locate, distinct, in place of the lists source_locates, which for a frequent name are as long as the corpus.
    """
    both = relations.select(F.inline(F.array(
        F.struct(F.col("source").alias("object_id"), F.col("target").alias("t"), "weight"),
        F.struct(F.col("target").alias("object_id"), F.col("source").alias("t"), "weight"),
    )))
    both = both.where("object_id <> t").join(entities.select(F.col("entity_id").alias("t"), "name"), "t", "left")
    listed = places is None
    places = entities.select("entity_id", F.explode("source_locates").alias("locate")) if listed else places
    places = merge_locates(places.select(F.col("entity_id").alias("object_id"), "locate"), distinct=not listed)
    return _cue(both, "entity", "semantic", F.col("t"), F.col("name"), ["t"], weight=F.col("weight")).unionByName(
        _cue(places, "entity", "provenance", None, None, ["locate"], locate=F.col("locate"))
    )


def relation_cues(relations: DataFrame) -> DataFrame:
    """Neighbours of both endpoints without the endpoints, sorted, and merged locates."""
    ends = relations.select(F.concat_ws("->", "source", "target").alias("object_id"), "source", "target", "source_locates")
    near = relations.select("source", "target").unionByName(relations.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().toDF("e", "t")
    asked = ends.select("object_id", "source", "target", F.explode(F.array("source", "target")).alias("e"))
    around = asked.join(near, "e").where("t <> source and t <> target").select("object_id", "t").distinct()
    places = merge_locates(ends.select("object_id", F.explode("source_locates").alias("locate")))
    return _cue(around, "relation", "semantic", F.col("t"), None, ["t"]).unionByName(
        _cue(places, "relation", "provenance", None, None, ["locate"], locate=F.col("locate"))
    )


_CANDIDATES = 1 << 20


def _common(one: np.ndarray, two: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each edge of two groups stands in a triangle whose edges mine (places in the first) end where the second's begin.

    Groups are sorted keys, start << 32 | end.  Of both ends' edges the fewer are looked up among the other's.
    """
    u, v = one[mine] >> 32, one[mine] & 0xFFFFFFFF
    span = lambda keys, n: (np.searchsorted(keys, n << 32), np.searchsorted(keys, (n + 1) << 32))
    (ui, uj), (vi, vj) = span(one, u), span(two, v)
    n_one, n_two = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
    for few, first, last, own, other, start in ((uj - ui <= vj - vi, ui, uj, one, two, v), (uj - ui > vj - vi, vi, vj, two, one, u)):
        at = np.flatnonzero(few & (last > first))
        ends = np.cumsum(last[at] - first[at])
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _CANDIDATES)))
            some = at[i:j]
            n = last[some] - first[some]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
            key = np.repeat(start[some], n) << 32 | own[place] & 0xFFFFFFFF
            met = np.minimum(np.searchsorted(other, key), max(len(other) - 1, 0))
            hit = np.flatnonzero(other[met] == key) if len(other) else np.zeros(0, np.int64)
            n_one += np.bincount(np.repeat(mine[some], n)[hit], minlength=len(one))
            for group, found in ((own, place[hit]), (other, met[hit])):
                counts = n_one if group is one else n_two
                counts += np.bincount(found, minlength=len(group))
            i = j
    return n_one, n_two


def _triangles(pairs: DataFrame, degree: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], group_edges: int) -> DataFrame:
    """a, b, both: in how many triangles each pair stands, if in any.  pairs: a < b, distinct; degree: e, n, no."""
    held = dict(degree.groupBy(F.shiftright("no", 33)).count().collect())  # a row per partition, whose numbers then follow on one another
    starts = [(p, sum(n for other, n in held.items() if other < p)) for p in held] or [(0, 0)]
    starts = F.broadcast(pairs.sparkSession.createDataFrame(starts, "part long, start long"))
    named = degree.join(starts, F.shiftright("no", 33) == F.col("part")).select("e", "n", (F.col("start") + F.col("no").bitwiseAND((1 << 33) - 1)).alias("no"))
    named = checkpoint(named)
    side = lambda c: named.select(F.col("e").alias(c), F.struct("n", "no").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b")["no"].alias("u"), F.greatest("_a", "_b")["no"].alias("v"))
    both = checkpoint(both)
    groups = max(1, -(-both.count() // group_edges))

    def pack(t: pa.Table) -> pa.Table:
        keys = np.sort(t["u"].to_numpy() << 32 | t["v"].to_numpy())
        return pa.table({"g": pa.array([int(keys[0] >> 32) % groups]), "keys": pa.array([keys.tobytes()], pa.binary())})

    packs = checkpoint(both.groupBy(F.col("u") % groups).applyInArrow(pack, "g long, keys binary"))
    asked = both.select((F.col("u") % groups).alias("g"), (F.col("v") % groups).alias("h")).distinct()
    met = asked.join(packs, "g").join(packs.select(F.col("g").alias("h"), F.col("keys").alias("others")), "h").select("g", "h", "keys", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, h = (batch[c][i].as_py() for c in ("g", "h"))
                one, two = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("keys", "others"))
                for group, n in zip((g, h), _common(one, two, np.flatnonzero((one & 0xFFFFFFFF) % groups == h)), strict=True):
                    yield pa.RecordBatch.from_pydict({"g": [group], "n": [n.astype(np.int32).tobytes()]})

    def add(t: pa.Table) -> pa.Table:
        out = 0
        for n in t["n"]:
            out = out + np.frombuffer(n.as_buffer(), np.int32)
        return pa.table({"g": t["g"][:1], "n": pa.array([out.tobytes()], pa.binary())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = np.frombuffer(batch["keys"][i].as_buffer(), np.int64), np.frombuffer(batch["n"][i].as_buffer(), np.int32)
                for at in np.array_split(np.flatnonzero(n), 1 + len(n) // _CANDIDATES):
                    yield pa.RecordBatch.from_pydict({"u": keys[at] >> 32, "v": keys[at] & 0xFFFFFFFF, "both": n[at].astype(np.int64)})

    counts = met.mapInArrow(run, "g long, n binary").groupBy("g").applyInArrow(add, "g long, n binary")
    found = counts.join(packs, "g").mapInArrow(rows, "u long, v long, both long")
    name = lambda no, c: named.select(F.col("no").alias(no), F.col("e").alias(c))
    found = found.join(name("u", "_u"), "u").join(name("v", "_v"), "v")
    return found.select(F.least("_u", "_v").alias("a"), F.greatest("_u", "_v").alias("b"), "both")


def relation_neighbour_counts(relations: DataFrame, *, checkpoint: Callable[[DataFrame], DataFrame], group_edges: int = 1 << 21) -> DataFrame:
    """object_id, n: how many semantic cues ``relation_cues`` gives each relation that has some, without making them.

    Both ends' neighbours less those they share, which are the triangles on an edge.  Edges run from the end with fewer neighbours, so no
    node starts more than the root of twice their number.  Edges are dealt in packed groups of about ``group_edges`` by their start; a task
    meets two groups and holds no more, and only counts leave it.
    """
    ends = relations.select("source", "target").distinct()
    pairs = checkpoint(ends.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    degree = pairs.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    degree = checkpoint(degree.withColumn("no", F.monotonically_increasing_id()))
    shared = _triangles(pairs, degree, checkpoint, group_edges)
    degree = degree.select("e", "n")
    rows = ends.select(F.concat_ws("->", "source", "target").alias("object_id"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    rows = rows.join(degree.toDF("a", "na"), "a", "left").join(degree.toDF("b", "nb"), "b", "left").join(shared, ["a", "b"], "left")
    n = F.when(F.col("a") == F.col("b"), F.coalesce("na", F.lit(0))).otherwise(F.col("na") + F.col("nb") - 2 - F.coalesce("both", F.lit(0)))
    return rows.select("object_id", n.alias("n")).where("n > 0")


def summary_cues(summaries: DataFrame) -> DataFrame:
    """First parent, child summaries and chunks, and merged locates."""
    s = summaries.withColumn("object_id", F.col("node_id"))
    up = s.where("parent_node_id is not null").select("object_id", "parent_node_id")
    down = s.select("object_id", F.posexplode("child_node_ids").alias("i", "t"))
    places = merge_locates(s.select("object_id", F.explode("source_locates").alias("locate")))
    vertical = up.select("object_id", F.col("parent_node_id").alias("t"), F.lit(-1).alias("i")).unionByName(down.select("object_id", "t", "i"))
    return _cue(vertical, "summary", "vertical", F.col("t"), None, ["i"]).unionByName(
        _cue(places, "summary", "provenance", None, None, ["locate"], locate=F.col("locate"))
    )


def enrich(cues: DataFrame) -> DataFrame:
    """Score 1 / (1 + rank) to four digits and token cost of what a cue shows."""
    shown = F.concat_ws(" ", F.col("label"), F.coalesce("target_id", "locate"))
    return cues.withColumns({"score": F.round(1.0 / (1.0 + F.col("pos")), 4), "cost": T.cue_cost(shown)})


def apply_variant(cues: DataFrame, variant: str) -> DataFrame:
    gone = VARIANTS[variant]
    return cues.where(~F.col("family").isin(*gone)) if gone else cues


def top_b(cues: DataFrame, budgets: dict[str, int], default: int = 0) -> DataFrame:
    """At most a family's budget of cues per object; a budget of 0 and less means all."""
    limit = F.lit(default)
    for family, b in budgets.items():
        limit = F.when(F.col("family") == family, b).otherwise(limit)
    return cues.where((limit <= 0) | (F.col("pos") < limit))


def coverage(selected: DataFrame) -> DataFrame:
    """object_id, value: over evidence units the largest weight, summed."""
    units = selected.select("object_id", F.explode("units").alias("unit"), "weight").groupBy("object_id", "unit").agg(F.max("weight").alias("w"))
    return units.groupBy("object_id").agg(F.sum("w").alias("value"))


def select_greedy(cues: DataFrame, budget: int) -> DataFrame:
    """Budgeted maximum coverage per (object, family): gain, then score, then id; no gain, no cue.

    cues: object_id, family, cue_id, score, weight, units.  A gain only falls as cues are picked, so a gain worked out earlier is
    a bound: cues wait in a heap by it, and only the one on top is worked out again.  It is picked if it still is the best.  Each
    pick depends on those before, so a group, one object's cues of one family, is a grouped map.
    """

    def pick(t: pa.Table) -> pa.Table:
        numbers: dict = {}
        units = [[numbers.setdefault(u, len(numbers)) for u in us or ()] for us in t["units"].to_pylist()]
        ids, scores, weights = (t[c].to_pylist() for c in ("cue_id", "score", "weight"))
        covered = [0.0] * len(numbers)
        heap = [(-sum(max(0.0, w) for _ in us), -s, i, n) for n, (us, w, s, i) in enumerate(zip(units, weights, scores, ids, strict=True))]
        heapq.heapify(heap)
        out: list[tuple] = []
        while heap and len(out) < budget:
            _, score, cue, n = heap[0]
            now = (-sum(max(0.0, weights[n] - covered[u]) for u in units[n]), score, cue, n)
            if now[0] >= 0:
                heapq.heappop(heap)  # nothing left to gain, now or later
            elif now > min(heap[1:3], default=now):
                heapq.heapreplace(heap, now)
            else:
                heapq.heappop(heap)
                out.append((cue, len(out), -now[0]))
                for u in units[n]:
                    covered[u] = max(covered[u], weights[n])
        of = lambda c: t[c].take(pa.array([0] * len(out), pa.int64())).combine_chunks()
        picked = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.float64()))]
        return pa.Table.from_arrays([of("object_id"), of("family"), *picked], names=["object_id", "family", "cue_id", "pick", "gain"])

    rows = cues.select("object_id", "family", F.col("cue_id").cast("string").alias("cue_id"), F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight"), "units")
    return rows.groupBy("object_id", "family").applyInArrow(pick, "object_id string, family string, cue_id string, pick int, gain double")


def chain(questions: DataFrame, *, read_budget: int = 10, max_hops: int = 3, cues_per_family: int = 3) -> DataFrame:
    """Bounded best-first navigation per question over its pre-joined neighbourhood.

    questions: question_id, frontier array<struct<score, id>>, cues array<struct<object_id, family,
    pos, target_id, locate>>.  An object is taken by score, then order of arrival; its locates are
    read first while the budget lasts, then its read (horizontal), zoom (vertical) and jump (semantic)
    targets join the frontier with score 0.  Nothing is visited or read twice.  Returns one row per
    step: question_id, step, kind (expand or read), what.
    """
    schema = "question_id long, step int, kind string, what string"

    def walk(q) -> Iterator[tuple]:
        by_object: dict = {}
        for c in q.cues if q.cues is not None else []:
            by_object.setdefault(c["object_id"], {}).setdefault(c["family"], []).append(c)
        line = [(-float(f["score"]), i, f["id"]) for i, f in enumerate(q.frontier if q.frontier is not None else [])]
        seen, seq, step, budget, hops = set(), len(line), 0, read_budget, 0
        while line and hops < max_hops and budget > 0:
            line.sort()
            _, _, at = line.pop(0)
            if at in seen:
                continue
            seen.add(at)
            hops += 1
            yield q.question_id, step, "expand", at
            step += 1
            mine = by_object.get(at, {})
            for family, kind in (("provenance", "locate"), ("horizontal", "target_id"), ("vertical", "target_id"), ("semantic", "target_id")):
                taken = 0
                for c in sorted(mine.get(family, []), key=lambda c: c["pos"]):
                    to = c[kind]
                    if not to or to in seen:
                        continue
                    if taken >= cues_per_family:
                        break
                    taken += 1
                    if family == "provenance":
                        if budget <= 0:
                            break
                        seen.add(to)
                        budget -= 1
                        yield q.question_id, step, "read", to
                        step += 1
                    else:
                        line.append((0.0, seq, to))
                        seq += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([s for q in batch.itertuples(index=False) for s in walk(q)], columns=["question_id", "step", "kind", "what"])

    return questions.select("question_id", "frontier", "cues").mapInPandas(run, schema)
