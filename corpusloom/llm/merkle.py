"""Merkle manifest of a dataset: a root, node records, and a proof for every row.

1. Leaves are hashed in the JVM and stored; only digests and keys move from here on.  They are dealt by range of (group,
   order), so that a task holds a run of consecutive leaves of one or several groups and a hot group spreads over many
   tasks, and a table with a row per task and group says at which number each of these runs begins.
2. Each task climbs its runs with a mountain-range stack, a list of open nodes per level: when a level's counter reaches a multiple
   of the fanout, the run of nodes becomes its parent and carries on above.  A completed node is a record; nodes whose run
   began in an earlier task, and peaks whose run ends in a later one, are left open.  A group's last run is short and hashed as it is.
3. Open nodes, at most 2 * (fanout - 1) per level and task, are merged level by level: grouped by group and run, hashed, and
   passed on as open nodes of the next level, until every group is down to its subroot.  Subroots are leaves of the same
   construction, whose group is the whole dataset.
4. Proofs: a task needs, besides its own leaves, the open runs above its two edges, two per level at most, and its groups' proofs
   in the upper tree.  It climbs once more and folds every leaf up to the root.

Defined results: nulls are leaves like any other ("-" for a null value); null doc_ids come first in their source and are never
tampered with; rows that tie on the order are taken by their leaf, equal rows one after the other; a group of one leaf
is its own subroot; no rows give no rows.  Extra columns are ignored.  Texts of any length are one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import stored, table

FANOUT = 16
PART_ROWS = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings of a way up: those before and those behind the node, per level.
PATH = T.ArrayType(T.StructType().add("before", T.StringType()).add("after", T.StringType()))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_hash(values: Sequence[Column]) -> Column:
    """sha256 of the values one after the other, each with its byte count, so that no two rows read alike."""
    one = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*one), 256)


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def above(n: int, fanout: int) -> int:
    return -(-n // fanout)


class Mountains:
    """The stack of one run of consecutive leaves: open nodes per level, carried up when a run of ``fanout`` is whole.

    ``records`` gets (level, number, hash) of completed nodes, ``left_open`` of those whose run other tasks share,
    and of the group's root.
    """

    def __init__(self, start: int, total: int, fanout: int):
        self.fanout, self.at, self.totals, self.open = fanout, [start], [total], [[]]
        self.records: list[tuple[int, int, bytes]] = []
        self.left_open: list[tuple[int, int, bytes]] = []

    def push(self, node: bytes, level: int = 0) -> None:
        self.open[level].append(node)
        self.at[level] += 1
        if not self.at[level] % self.fanout:
            self._carry(level)

    def _carry(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        number = (self.at[level] - 1) // self.fanout
        if number * self.fanout != self.at[level] - len(run):
            return self._leave(level, run)
        if level + 1 == len(self.open):
            self.open.append([])
            self.at.append(number)
            self.totals.append(above(self.totals[level], self.fanout))
        node = digest(b"".join(run))
        self.records.append((level + 1, number, node))
        self.push(node, level + 1)

    def _leave(self, level: int, run: list[bytes]) -> None:
        first = self.at[level] - len(run)
        self.left_open.extend((level, first + i, h) for i, h in enumerate(run))

    def close(self) -> None:
        level = 0
        while level < len(self.open):
            if run := self.open[level]:
                if 1 < self.totals[level] == self.at[level]:
                    self._carry(level)
                else:
                    self._leave(level, run)
            level += 1


@dataclass(frozen=True)
class Tree:
    """``rows``: leaves by _part and _place; ``runs``: where each task's run of a group begins; ``open_runs``: merged runs with
    their members; ``nodes``: records of completed nodes; ``roots``: one hash per group."""

    rows: DataFrame
    runs: DataFrame
    open_runs: DataFrame
    nodes: DataFrame
    roots: DataFrame
    group: list[str]
    fanout: int
    depth: int


def placed(leaves: DataFrame, group: Sequence[str], order: Sequence[str], part_rows: int) -> DataFrame:
    """Stored leaves with _part and _place: ranges of (group, order, leaf), equal rows in any order but always the same."""
    held = stored(leaves.withColumn("_row", F.monotonically_increasing_id()))
    by = [*group, *order, "leaf", "_row"]
    parts = max(1, above(held.count(), part_rows))
    dealt = held.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_row")
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    return stored(dealt.withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1)))


def build(leaves: DataFrame, group: Sequence[str], order: Sequence[str], *, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> Tree:
    """leaves: group (never null), order, leaf (hex) and further columns that proofs give back."""
    group = list(group)
    rows = placed(leaves, group, order, part_rows)
    runs = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*group)
    runs = runs.withColumn("_start", F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).withColumn("_total", F.sum("_n").over(whole))
    runs = stored(runs)
    depth, n = 0, runs.agg(F.max("_total")).first()[0] or 1
    while n > 1:
        depth, n = depth + 1, above(n, fanout)
    schema = runs.select(*group).schema.add("level", T.IntegerType()).add("number", T.LongType()).add("hash", T.StringType())
    schema = schema.add("_total", T.LongType()).add("_open", T.BooleanType())
    names, width = schema.names, len(group)

    def climb(leaves_of: pa.Table, runs_of: pa.Table) -> pa.Table:
        got = leaves_of.sort_by("_place").column("leaf").to_pylist()
        where, found = [], []
        for i, (first, n, start, total) in enumerate(zip(*(runs_of.column(c).to_pylist() for c in ("_first", "_n", "_start", "_total")), strict=True)):
            m = Mountains(start, total, fanout)
            for h in got[first : first + n]:
                m.push(h.encode())
            m.close()
            for kind, nodes in ((False, m.records), (True, m.left_open)):
                for level, number, h in nodes:
                    where.append(i)
                    found.append((level, number, h.decode(), total, kind))
        columns = [runs_of.column(c).take(pa.array(where, pa.int64())) for c in names[:width]]
        types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        columns += [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
        return pa.Table.from_arrays(columns, names)

    slim = rows.select("_part", "_place", "leaf").groupBy("_part").cogroup(runs.groupBy("_part"))
    found = stored(slim.applyInArrow(climb, schema))
    return _merged(rows, runs, found, group, fanout, depth)


def _merged(rows: DataFrame, runs: DataFrame, found: DataFrame, group: list[str], fanout: int, depth: int) -> Tree:
    """Merges open nodes level by level; _total is a group's number of leaves, from which follows that of each level."""
    key = [*group, "_total"]
    nodes = found.where("not _open").select(*group, "level", "number", "hash")
    empty = found.where("_open and level < 0").select(*key, "level", F.col("number").alias("run"), F.array("hash").alias("members"), "hash")
    rest, open_runs, roots = None, empty, None
    for level in range(depth + 1):
        here = found.where(f"_open and level = {level}").select(*key, "number", "hash")
        here = here if rest is None else here.unionByName(rest)
        size = F.ceil(F.col("_total") / F.lit(fanout**level)).cast("long")
        top = here.where(size == 1).select(*group, "hash")
        roots = top if roots is None else roots.unionByName(top)
        if level == depth:
            break
        members = F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda m: m["hash"])
        made = here.where(size > 1).groupBy(*key, F.expr(f"number div {fanout}").alias("run")).agg(members.alias("members"))
        made = stored(made.withColumn("hash", F.sha2(F.array_join("members", ""), 256)).withColumn("level", F.lit(level)))
        rest = made.select(*key, F.col("run").alias("number"), "hash")
        open_runs = open_runs.unionByName(made)
        nodes = nodes.unionByName(made.select(*group, (F.col("level") + 1).alias("level"), F.col("run").alias("number"), "hash"))
    return Tree(rows, runs, open_runs, nodes, stored(roots), group, fanout, depth)


def _context(tree: Tree, upper: DataFrame | None) -> DataFrame:
    """The runs table with the open runs above both edges (``above``), the group's root and its proof in the upper tree."""
    key = ["_part", *tree.group]
    levels = F.explode(F.expr(f"transform(sequence(0, {max(tree.depth - 1, 0)}), l -> struct(l AS level, cast(pow({tree.fanout}, l + 1) as bigint) AS span))"))
    edges = tree.runs.select(*key, "_n", "_start", "_total", levels.alias("_l")).select("*", "_l.*")
    edges = edges.where(F.ceil(F.col("_total") * tree.fanout / F.col("span")) > 1)
    edges = edges.withColumn("run", F.explode(F.array_distinct(F.array(F.expr("_start div span"), F.expr("(_start + _n - 1) div span")))))
    inside = (F.col("run") * F.col("span") >= F.col("_start")) & (F.least((F.col("run") + 1) * F.col("span"), "_total") <= F.col("_start") + F.col("_n"))
    needed = stored(edges.where(~inside).select(*key, "level", "run"))
    got = needed.join(stored(tree.open_runs.select(*tree.group, "level", "run", "members")), [*tree.group, "level", "run"])
    got = got.groupBy(*key).agg(F.collect_list(F.struct("level", "run", "members")).alias("_above"))
    out = tree.runs.join(got, key, "left").join(tree.roots.withColumnRenamed("hash", "subroot"), tree.group)
    if upper is None:
        return out.withColumns({"root": F.col("subroot"), "_upper": F.array().cast(PATH)})
    return out.join(upper.select(*tree.group, "root", F.col("path").alias("_upper")), tree.group)


class Climber:
    """Runs of nodes on all levels over one task's leaves of a group, and the way from a node to the root."""

    def __init__(self, leaves: list[bytes], start: int, total: int, fanout: int, outside: dict, upper: list[tuple[bytes, bytes]]):
        self.fanout, self.upper, self.levels, self.known, self.ways = fanout, upper, [], {}, {}
        nodes, level = leaves, 0
        while total > 1:
            runs = {}
            for r in range(start // fanout, (start + len(nodes) - 1) // fanout + 1):
                runs[r] = b"".join(outside.get((level, r)) or nodes[r * fanout - start : min((r + 1) * fanout, total) - start])
            self.levels.append(runs)
            nodes, start, total, level = [digest(x) for x in runs.values()], start // fanout, above(total, fanout), level + 1
        self.upper_way = b"".join([b + a for b, a in upper])

    def sides(self, level: int, number: int) -> tuple[bytes, bytes]:
        run, at = self.levels[level][number // self.fanout], number % self.fanout * 64
        return run[:at], run[at + 64 :]

    def way(self, level: int, number: int) -> bytes:
        """The siblings from a node up to the root, one after the other."""
        if level == len(self.levels):
            return self.upper_way
        own = b"".join(self.sides(level, number))
        if not level:
            return own + self.way(1, number // self.fanout)
        if (level, number) not in self.ways:
            self.ways[level, number] = own + self.way(level + 1, number // self.fanout)
        return self.ways[level, number]

    def fold(self, level: int, number: int, node: bytes) -> bytes:
        """The root that follows from a node and its siblings."""
        key = (level, number // self.fanout if level < len(self.levels) else 0, number % self.fanout, node)
        if key not in self.known:
            if level < len(self.levels):
                before, after = self.sides(level, number)
                self.known[key] = self.fold(level + 1, number // self.fanout, digest(before + node + after))
            else:
                for before, after in self.upper:
                    node = digest(before + node + after)
                self.known[key] = node
        return self.known[key]


def proofs(tree: Tree, *, upper: DataFrame | None = None, claimed: str | None = None, paths: bool = False) -> DataFrame:
    """The leaves' rows with subroot, root, proof_sha256, folded_root and, with ``paths``, path (before, after per level).

    upper: group, root and path of the tree over this tree's roots, as this function gives them.  ``claimed``: a column with the
    leaf to fold where it is not null, instead of the row's own.
    """
    own = [f for f in tree.rows.schema if f.name not in ("_part", "_place")]
    schema = tree.rows.select(*[f.name for f in own]).schema
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, T.StringType())
    if paths:
        schema = schema.add("path", PATH)
    fanout, depth_names = tree.fanout, schema.names
    path_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def prove(leaves_of: pa.Table, runs_of: pa.Table) -> pa.Table:
        leaves_of = leaves_of.sort_by("_place")
        leaf = [h.encode() for h in leaves_of.column("leaf").to_pylist()]
        said = leaves_of.column(claimed).to_pylist() if claimed else [None] * len(leaf)
        out: dict[str, list] = {n: [None] * len(leaf) for n in depth_names[len(own) :]}
        for run in runs_of.to_pylist():
            first, n, start = run["_first"], run["_n"], run["_start"]
            outside = {(x["level"], x["run"]): [m.encode() for m in x["members"]] for x in run["_above"] or ()}
            upper_path = [(x["before"].encode(), x["after"].encode()) for x in run["_upper"]]
            c = Climber(leaf[first : first + n], start, run["_total"], fanout, outside, upper_path)
            for i in range(n):
                at = first + i
                out["subroot"][at], out["root"][at] = run["subroot"], run["root"]
                out["proof_sha256"][at] = hashlib.sha256(c.way(0, start + i)).hexdigest()
                claim = said[at].encode() if said[at] is not None else leaf[at]
                out["folded_root"][at] = c.fold(0, start + i, claim).decode()
                if paths:
                    steps = [c.sides(level, (start + i) // fanout**level) for level in range(len(c.levels))]
                    out["path"][at] = [{"before": b.decode(), "after": a.decode()} for b, a in [*steps, *upper_path]]
        columns = [leaves_of.column(f.name) for f in own]
        columns += [pa.array(v, path_type if n == "path" else pa.string()) for n, v in out.items()]
        return pa.Table.from_arrays(columns, depth_names)

    context = stored(_context(tree, upper))
    return tree.rows.groupBy("_part").cogroup(context.groupBy("_part")).applyInArrow(prove, schema)


def grouped(docs: DataFrame, group: str) -> DataFrame:
    """Adds _known and _group, whose order is that of the group with null first; neither is ever null."""
    return docs.withColumns({"_known": F.col(group).isNotNull(), "_group": F.coalesce(F.col(group).cast("string"), F.lit(""))})


def manifest(leaves: DataFrame, group: str, order: str, *, fanout: int = FANOUT, part_rows: int = PART_ROWS) -> tuple[Tree, Tree]:
    """The tree of every group and the tree over their subroots; ``nodes`` and ``roots`` of both are the manifest.

    leaves: group, order, leaf (hex) and further columns.
    """
    lower = build(grouped(leaves, group), ["_known", "_group"], [order], fanout=fanout, part_rows=part_rows)
    tops = lower.roots.select(F.lit(0).alias("_all"), "_known", "_group", F.col("hash").alias("leaf"))
    return lower, build(tops, ["_all"], ["_known", "_group"], fanout=fanout, part_rows=part_rows)


def proved(lower: Tree, top: Tree, claimed: str | None = None) -> DataFrame:
    """The lower tree's leaves with their proofs up to the root of the dataset."""
    upper = stored(proofs(top, paths=True).select("_known", "_group", "root", "path"))
    return proofs(lower, upper=upper, claimed=claimed)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = F.translate("text", UPPER, UPPER.lower())
    tampered = leaf_hash([lowered if c == "text" else F.col(c) for c in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_hash([F.col(c) for c in FIELDS]).alias("leaf"), F.when(chosen, tampered).alias("tampered"))
    out = proved(*manifest(leaves, "source", "doc_id"), claimed="tampered")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)
    ) + ")"


_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(4294967295, list_reduce([4294967295::ubigint] || list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d)::ubigint), lambda c, b: {_BITS}))"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """name_n: nodes of all levels over leaves (key, i, n, h); name_r: their runs; name_f: leaves (key, i, h, p) folded to the top."""
    return f"""
{name}_n as (
  select 0 level, {key}, i, n, h from {leaves}
  union all
  select level + 1, {key}, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' order by i)) from {name}_n where n > 1
  group by level, {key}, i // {FANOUT}, n),
{name}_r as (select level, {key}, i // {FANOUT} run, list(h order by i) m from {name}_n where n > 1 group by all)"""


def _fold_sql(name: str, leaves: str, key: str, rest: str) -> str:
    before = f"array_to_string(m[1:f.i % {FANOUT}], '')"
    after = f"array_to_string(m[f.i % {FANOUT} + 2:], '')"
    return f"""
{name}_f as (
  select 0 level, {key}, i, n, h, p, {rest} from {leaves}
  union all
  select f.level + 1, f.{key}, f.i // {FANOUT}, (f.n + {FANOUT - 1}) // {FANOUT}, sha256({before} || f.h || {after}), f.p || {before} || {after},
    {", ".join(f"f.{c.strip()}" for c in rest.split(","))}
  from {name}_f f join {name}_r r on r.level = f.level and r.{key} is not distinct from f.{key} and r.run = f.i // {FANOUT} where f.n > 1)"""


OP12_SQL = f"""
with recursive leaves as (
  select doc_id, source, {_leaf_sql("text")} leaf,
    case when {_CRC} % 5 = 0 then {_leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} end tampered from documents),
a as (select *, leaf h, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n from leaves),
{_tree_sql("low", "a", "source")},
subs as (select 0 as every, source, h, row_number() over (order by source nulls first) - 1 i, count(*) over () n from low_n where n = 1),
{_tree_sql("top", "subs", "every")},
start_ as (select source, i, n, coalesce(tampered, leaf) h, '' p, doc_id, leaf from a),
{_fold_sql("low", "start_", "source", "doc_id, leaf")},
middle as (select s.every, s.i, s.n, f.h, f.p, f.doc_id, f.leaf, s.h subroot from low_f f join subs s on s.source is not distinct from f.source where f.n = 1),
{_fold_sql("top", "middle", "every", "doc_id, leaf, subroot")}
select doc_id, leaf, subroot, (select h from top_n where n = 1) root, sha256(p) proof_sha256, h folded_root, h = (select h from top_n where n = 1) verified
from top_f where n = 1
"""
