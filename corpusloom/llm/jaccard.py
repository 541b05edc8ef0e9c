"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles; two link when the Jaccard similarity of their sets reaches the
threshold t.  The result is exact (to 64-bit hashes) and gives connected classes, never all pairs.

1. Sharing.  Every document sends its shingles, packed by hash bucket (about 5 bytes each); a bucket
   counts for each document the shingles that another document has too.  A link needs a common part
   of t times either set, so documents with fewer shared shingles are out.  Documents with equal sets
   become one representative, the smallest doc_id.  A task settles both among its own documents first
   and sends a shingle or a set that many of them have once.
2. Groups.  Two linked sets share a shingle among the first n - ceil(t n) + 1 of each in any common
   order.  Buckets count the representatives with each shingle, documents order theirs by frequency and
   hash, and joining documents on prefixes gives groups outside of which no link exists; a passage
   common to many documents joins only those made of such passages.
3. Matrix.  Groups are dealt to tasks of bounded size (``task_shingles``); a larger group is split by
   set size (linked sets differ by a factor 1 / t at most, so only neighbouring classes of sizes meet)
   and hash, and the parts share a few pivots.  A task divides its documents by first shingle, stores
   the union of each division's shingles as a sparse token-group matrix, counts each query's overlap with
   every union, and opens only divisions whose overlap reaches t times the query's size.  Documents
   already joined to the largest class need no query: links among them add nothing.
4. Rest.  In a split group whose parts did not come together, the documents outside its largest class
   are compared, in tasks of bounded size, with every part of neighbouring sizes.  Such a group of many
   small classes costs tasks in the square of its size over ``task_shingles``.
5. Classes.  Connected components of the links.

Buckets compare 32 bits beside the bucket's number, which can only let more documents through steps 1
and 2; links are decided by all 64.

Defined results: null and empty text have no shingles and link with nothing; fewer than k words are
one shingle, the whole sequence; rows with equal doc_id are one document; null doc_id gives a row
with its shingle count of 0 and no component; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import long_id, stored, table, text_bytes
from corpusloom.llm.graphs import components
from corpusloom.llm.words import (
    PACKED, Gathered, Texts, U, answers, bucket_count, by_bucket, flush_size, found_values, gathered, mixed, of_kind, packed_rows, run_hashes, share_of,
    slices, sorted_pairs, to_batch, unpacked,
)

K = 5
PERCENT = 75
TASK_SHINGLES = 1_500_000
PIVOTS = 8
_BASE = 0x27D4EB2F165667C5


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each document's distinct shingles, sorted by both."""
    t.hash_words()
    at, h = t.windows(k, _BASE)
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < k))
    doc = np.concatenate([t.doc[at], short])
    h = np.concatenate([h, run_hashes(t.h, t.word_at[short], t.word_at[short + 1], _BASE)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) % U(buckets)).astype(np.int32)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & U(0xFFFFFFFF)).astype(np.uint32)


#: Size and digest of a set, sent to the bucket of its first shingle; size and representative.
_HEAD = np.dtype([("n", "u8"), ("k1", "u8"), ("k2", "u8")])
_REP = np.dtype([("n", "i8"), ("rep", "i8")])
#: Kinds of rows: a shingle of one document, a set, a shingle that a task found in several documents;
#: and to shares of the documents: shared shingles, a size and representative.
_ONE, _SET, _MANY, _SHARED, _FOUND = range(5)

# --- 1. sharing -----------------------------------------------------------------------------------


def _representatives(doc: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by set and document, and for each in it the smallest document with the same set."""
    order = np.lexsort((doc, head["n"], head["k2"], head["k1"]))
    doc, head = doc[order], head[order]
    first = np.concatenate([[True], head[1:] != head[:-1]])[: len(doc)]
    return order, doc[np.flatnonzero(first)][np.cumsum(first) - 1]


def _rep_rows(doc: np.ndarray, n: np.ndarray, rep: np.ndarray, shares: int) -> list[tuple]:
    value = np.zeros(len(doc), dtype=_REP)
    value["n"], value["rep"] = n, rep
    return packed_rows(doc, share_of(doc, shares), value, _FOUND)


def sent_shingles(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Packed shingles and sets, and what a task knows already."""

    def told(doc: np.ndarray, h: np.ndarray) -> list[tuple]:
        doc, h, start, end = sorted_pairs(doc, h)
        several = end - start > 1
        alone = np.repeat(~several, end - start)
        rows = packed_rows(doc[alone], _bucket(h[alone], buckets), _low(h[alone]), _ONE)
        many = h[start[several]]
        rows += packed_rows(np.zeros(len(many), np.int64), _bucket(many, buckets), _low(many), _MANY)
        found, n = np.unique(doc[~alone], return_counts=True)
        return rows + packed_rows(found, share_of(found, buckets), n.astype(np.uint32), _SHARED)

    def sets(doc: np.ndarray, bucket: np.ndarray, head: np.ndarray) -> list[tuple]:
        order, rep = _representatives(doc, head)
        doc, bucket, head = doc[order], bucket[order], head[order]
        own = doc == rep
        rows = packed_rows(doc[own], bucket[own], head[own], _SET)
        return rows + _rep_rows(doc[~own], head["n"][~own], rep[~own], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads = Gathered(2, flush_size(buckets)), Gathered(3, 0)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for t in slices(batch, lower=True):
                doc, h = shingle_sets(t, k)
                n = np.bincount(doc, minlength=t.n)
                some = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n)])[some]
                sums = [np.add.reduceat(x, first) if len(first) else x[:0] for x in (mixed(h), mixed(h * U(_BASE) + U(1)))]
                head = np.zeros(len(some), dtype=_HEAD)
                head["n"], head["k1"], head["k2"] = n[some], *sums
                heads.add(ids[t.first + some], _bucket(h[first], buckets), head)
                if held.add(ids[t.first + doc], h):
                    yield to_batch(told(*held.take()) + sets(*heads.take()))
        if rest := held.take():
            yield to_batch(told(*rest) + sets(*heads.take()))

    return docs.mapInArrow(run, PACKED)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("shared", pa.int64())])


def shared_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, rep, shared: size of the set, a smaller document with the same set (or itself; its own
    rep is the smallest of all), and how many shingles others have, at least.

    Buckets answer in packed rows per share of the documents, and a share adds them up.
    """

    def run(t: pa.Table) -> pa.Table:
        doc, h = unpacked(of_kind(t, _ONE), np.uint32)
        _, many = unpacked(of_kind(t, _MANY), np.uint32)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        size = np.diff(np.concatenate([start, [len(h)]]))
        # two documents have it (two shingles of one may look equal), or a task found several
        shared = (doc[start] != doc[start + size - 1]) | np.isin(h[start], many)
        found, n = np.unique(doc[np.repeat(shared, size)], return_counts=True)
        rows = packed_rows(found, share_of(found, buckets), n.astype(np.uint32), _SHARED)
        hdoc, head = unpacked(of_kind(t, _SET), _HEAD)
        order, rep = _representatives(hdoc, head)
        rows += _rep_rows(hdoc[order], head["n"][order], rep, buckets)
        return pa.concat_tables([of_kind(t, _SHARED), of_kind(t, _FOUND), pa.Table.from_batches([to_batch(rows)])])

    def add(t: pa.Table) -> pa.Table:
        hdoc, found = unpacked(of_kind(t, _FOUND), _REP)
        order = np.lexsort((found["rep"], found["n"], hdoc))
        hdoc, found = hdoc[order], found[order]
        ids, first = np.unique(hdoc, return_index=True)
        doc, n = unpacked(of_kind(t, _SHARED), np.uint32)
        shared = np.bincount(np.searchsorted(ids, doc), weights=n, minlength=len(ids)).astype(np.int64)
        values = (ids, np.ascontiguousarray(found["n"][first]), np.ascontiguousarray(found["rep"][first]), shared)
        return pa.Table.from_arrays([pa.array(x) for x in values], schema=_COUNTED)

    out = by_bucket(packed, buckets).applyInArrow(run, PACKED)
    return by_bucket(out, buckets).applyInArrow(add, "doc_id long, n long, rep long, shared long")


# --- 2. groups ------------------------------------------------------------------------------------


class Forest:
    """Union-find over small integers; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], dtype=np.int64)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest_edges(ids: np.ndarray, forest: Forest) -> pa.RecordBatch:
    roots = forest.roots()
    moved = roots != np.arange(len(roots))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], schema=_EDGE)


def frequencies(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Answers: for each shingle that other documents have too, its key and the logarithm of the
    number of documents with it, in one value."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(3, flush_size(buckets))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for t in slices(batch, lower=True):
                doc, h = shingle_sets(t, k)
                if held.add(ids[t.first + doc], _bucket(h, buckets), _low(h)):
                    yield to_batch(packed_rows(*held.take(), 0))
        if rest := held.take():
            yield to_batch(packed_rows(*rest, 0))

    def count(t: pa.Table) -> pa.Table:
        doc, h, start, end = sorted_pairs(*unpacked(t, np.uint32))
        level = np.repeat(np.log2(end - start).astype(np.uint64), end - start)
        many = level > 0
        key = (np.uint64(t["bucket"][0].as_py()) << U(32)) | h[many].astype(np.uint64)
        return answers(doc[many], (key << U(6)) | level[many], buckets)

    return by_bucket(docs.mapInArrow(send, PACKED), buckets).applyInArrow(count, PACKED)


def prefix_edges(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """a, b: joins every two documents that share a prefix shingle, as forests per bucket.

    docs: doc_id, text, found.  Shingles are ordered by frequency, then hash, so that a prefix holds a
    document's rarest shingles and common passages join only documents made of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(3, flush_size(buckets))
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), found_values(batch.column(2))
            for t in slices(batch, lower=True):
                doc, h = shingle_sets(t, k)
                n = np.bincount(doc, minlength=t.n)
                first = np.concatenate([[0], np.cumsum(n)])
                key = (_bucket(h, buckets).astype(np.uint64) << U(32)) | _low(h).astype(np.uint64)
                level = np.zeros(len(h), dtype=np.int64)
                for d, f in enumerate(found[t.first : t.last]):
                    mine = slice(first[d], first[d + 1])
                    if f is not None and n[d]:
                        pos = np.minimum(np.searchsorted(f >> U(6), key[mine]), len(f) - 1)
                        level[mine] = np.where(f[pos] >> U(6) == key[mine], f[pos] & U(63), U(0))
                order = np.lexsort((h, level, doc))
                doc, h, level = doc[order], h[order], level[order]
                early = (np.arange(len(doc)) - first[doc] < prefix_length(n, percent)[doc]) & (level > 0)
                if held.add(ids[t.first + doc[early]], _bucket(h[early], buckets), _low(h[early])):
                    yield to_batch(packed_rows(*held.take(), 0))
        if rest := held.take():
            yield to_batch(packed_rows(*rest, 0))

    def meet(t: pa.Table) -> pa.Table:
        doc, h = unpacked(t, np.uint32)
        ids, doc = np.unique(doc, return_inverse=True)
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        leader = doc[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(h) else doc
        pairs = np.unique(np.stack([doc, leader], axis=1)[doc != leader], axis=0)
        forest = Forest(len(ids))
        for a, b in pairs.tolist():
            forest.join(a, b)
        return pa.Table.from_batches([_forest_edges(ids, forest)])

    return by_bucket(docs.mapInArrow(send, PACKED), buckets).applyInArrow(meet, "a long, b long")


# --- 3. matrix ------------------------------------------------------------------------------------


class Matrix:
    """Documents of one task: divisions by first shingle, and which divisions hold each shingle."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, n_docs: int):
        self.n = np.bincount(doc, minlength=n_docs)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        tokens, tok = np.unique(h, return_inverse=True)
        self.tok = tok
        some = self.n > 0
        self.division = np.full(n_docs, -1)
        _, self.division[some] = np.unique(tok[self.at[:-1][some]], return_inverse=True)
        self.n_div = int(self.division.max(initial=-1)) + 1
        pairs = np.unique(tok.astype(np.int64) * max(self.n_div, 1) + self.division[doc])
        self.pair_div = pairs % max(self.n_div, 1)
        self.pair_at = np.searchsorted(pairs // max(self.n_div, 1), np.arange(len(tokens) + 1))
        order = np.argsort(self.division, kind="stable")
        self.members = np.split(order, np.searchsorted(self.division[order], np.arange(self.n_div)))[1:] if self.n_div else []
        self.mark = np.zeros(len(tokens), dtype=bool)

    def opened(self, q: int, percent: int) -> np.ndarray:
        """Divisions whose union holds enough of q's shingles."""
        toks = self.tok[self.at[q] : self.at[q + 1]]
        lo, size = self.pair_at[toks], self.pair_at[toks + 1] - self.pair_at[toks]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        overlap = np.bincount(self.pair_div[flat], minlength=self.n_div)
        return np.flatnonzero(100 * overlap >= percent * self.n[q])

    def links(self, q: int, percent: int) -> Iterator[int]:
        """Members of opened divisions that link with q."""
        mine = slice(self.at[q], self.at[q + 1])
        self.mark[self.tok[mine]] = True
        for g in self.opened(q, percent):
            d = self.members[g]
            d = d[(d != q) & (100 * np.minimum(self.n[d], self.n[q]) >= percent * np.maximum(self.n[d], self.n[q]))]
            for part in np.array_split(d, max(1, int(self.n[d].sum() // 2_000_000))):
                if not len(part):
                    continue
                size = self.n[part]
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                flat = np.repeat(self.at[part] - start, size) + np.arange(size.sum())
                both = np.add.reduceat(self.mark[self.tok[flat]].astype(np.int64), start)
                yield from part[100 * both >= percent * (size + self.n[q] - both)].tolist()
        self.mark[self.tok[mine]] = False


def _sets_of(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    base = 0
    for batch in t.combine_chunks().to_batches():
        for s in slices(batch, lower=True):
            doc, h = shingle_sets(s, k)
            docs.append(base + s.first + doc)
            hashes.append(h)
        base += batch.num_rows
    return np.concatenate(docs), np.concatenate(hashes)


def links_in_tasks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: doc_id, text, ask (0 member, 1 query, 2 pivot), task.  a, b: forests of links per task.

    Without explicit queries, pivots (or the first documents) ask first, then all outside the
    largest class.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending")])
        ids, ask = t["doc_id"].to_numpy(), t["ask"].to_numpy()
        doc, h = _sets_of(t, k)
        m = Matrix(doc, h, len(ids))
        forest = Forest(len(ids))
        for a in np.flatnonzero(ids[1:] == ids[:-1]).tolist():
            forest.join(a, a + 1)

        def put(queries: np.ndarray) -> None:
            for q in queries.tolist():
                for d in m.links(q, percent):
                    forest.join(q, d)

        filled = m.n > 0
        if (ask == 1).any():
            put(np.flatnonzero(filled & (ask == 1)))
        else:
            first = np.flatnonzero(filled & (ask == 2)) if (ask == 2).any() else np.flatnonzero(filled)[:PIVOTS]
            put(first)
            roots = forest.roots()
            largest = np.bincount(roots).argmax() if len(roots) else -1
            rest = filled & (roots != largest)
            rest[first] = False
            put(np.flatnonzero(rest))
        return pa.Table.from_batches([_forest_edges(ids, forest)])

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


# --- the join -------------------------------------------------------------------------------------


def _size_class(n, percent: int):
    """Linked sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("long")


def similar_classes(documents: DataFrame, *, k: int = K, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (null without doc_id), one row per row of documents."""
    docs = documents.select(long_id(documents), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where(F.col("doc_id").isNotNull())
    buckets = bucket_count(text_bytes(known))
    counts = stored(shared_counts(sent_shingles(known, k, buckets), buckets))
    able = counts.where(100 * F.col("shared") >= percent * F.col("n")).select("doc_id", F.col("rep").alias("near"), "n")
    # a representative among a task's documents, then that one's among all: no key has all of a class
    onward = able.select(F.col("doc_id").alias("near"), F.col("near").alias("rep"))
    members = stored(able.join(onward, "near").select("doc_id", "near", "rep", "n"))
    reps = members.where("doc_id = rep").select("doc_id", "n")
    # by merging at every size: the lists of documents grow with the input and are never broadcast
    texts = stored(known.join(reps.select("doc_id").hint("merge"), "doc_id", "left_semi"))

    rare = texts.join(gathered(frequencies(texts, k, buckets), buckets).hint("merge"), "doc_id").select("doc_id", "text", "found")
    grouped = components(prefix_edges(rare, k, percent, buckets)).select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    sized = stored(reps.join(grouped, "doc_id").withColumn("c", _size_class(F.col("n"), percent)))  # alone in its group: no link
    total = sized.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // task_shingles))
    # only groups above a task's size have rows here: at most ``bins`` times the classes of sizes in one
    large = sized.groupBy("g").agg(F.sum("n").alias("w")).where(F.col("w") > task_shingles).select("g")
    large = stored(large)
    blocks = stored(
        sized.join(large, "g", "left_semi").groupBy("g", "c").agg(F.greatest(F.ceil(F.sum("n") / task_shingles), F.lit(1)).cast("long").alias("parts"))
    )
    zero = F.lit(0).cast("long")
    home = lambda x, c, y, z: F.struct(x.alias("x"), c.alias("c"), y.alias("y"), z.alias("z")).alias("task")
    # a small group is dealt to a bin with others; negative groups are bins
    small = sized.join(large, "g", "left_anti")
    tasks = small.select("doc_id", F.lit(0).alias("ask"), home(-1 - F.pmod(F.xxhash64("g"), F.lit(bins)), zero, zero, zero))
    split = stored(sized.join(blocks, ["g", "c"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")))
    some = not large.isEmpty()
    if some:
        rank = F.row_number().over(Window.partitionBy("g", "c").orderBy("doc_id"))
        pivots = split.withColumn("r", rank).where(F.col("r") <= PIVOTS).select("doc_id", "g", _neighbours("c"))
        pivots = pivots.join(blocks, ["g", "c"]).select("doc_id", "g", "c", F.explode(F.expr("sequence(0L, parts - 1)")).alias("y"))
        told = split.select("doc_id", F.lit(0).alias("ask"), home(F.col("g"), F.col("c"), F.col("part"), zero))
        asked = pivots.select("doc_id", F.lit(2).alias("ask"), home(F.col("g"), F.col("c"), F.col("y"), zero))
        tasks = tasks.unionByName(told.unionByName(asked).groupBy("doc_id", "task").agg(F.max("ask").alias("ask")))
    links = stored(links_in_tasks(texts.join(tasks.hint("merge"), "doc_id"), k, percent))
    classes = components(links)

    if some:
        now = split.join(classes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        now = stored(now.withColumn("component", F.coalesce("component", "doc_id")))
        held = now.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m"))
        largest = stored(held.groupBy("g").agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("main")))
        rest = now.join(largest, "g").where(F.col("component") != F.col("main")).select("doc_id", "g", "n", _neighbours("c"))
        rest = stored(rest.join(blocks, ["g", "c"]))
        asks = stored(rest.groupBy("g", "c").agg(F.greatest(F.ceil(F.sum("n") / task_shingles), F.lit(1)).cast("long").alias("asks")))
        rest = rest.join(asks, ["g", "c"]).withColumn("z", F.pmod(F.xxhash64("doc_id"), "asks"))
        asked = rest.select("doc_id", F.lit(1).alias("ask"), "g", "c", F.explode(F.expr("sequence(0L, parts - 1)")).alias("y"), "z")
        told = now.join(asks, ["g", "c"]).select("doc_id", F.lit(0).alias("ask"), "g", "c", F.col("part").alias("y"), F.explode(F.expr("sequence(0L, asks - 1)")).alias("z"))
        more = asked.unionByName(told).groupBy("doc_id", "g", "c", "y", "z").agg(F.max("ask").alias("ask"))
        more = more.select("doc_id", "ask", home(F.col("g"), F.col("c"), F.col("y"), F.col("z")))
        links = links.unionByName(links_in_tasks(texts.join(more.hint("merge"), "doc_id"), k, percent))
        classes = components(links)

    onward = members.select("near", "rep").distinct()
    onward = onward.join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    onward = stored(onward.select("near", F.coalesce("component", "rep").alias("component")))
    found = members.select("doc_id", "near").join(onward, "near", "left").select("doc_id", "component")
    out = docs.select("doc_id").join(counts.select("doc_id", "n"), "doc_id", "left").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _neighbours(c: str):
    """A row for each class of sizes that may link with this one."""
    return F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
