"""Lines, headings, trees and chunks of documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

CHUNK_SCHEMA = (
    "doc_id string, file_name string, content string, start_line int, end_line int,"
    " section_path array<string>, merge string, chunk_index int"
)

_INT, _TEXT, _TEXTS = pa.int32(), pa.string(), pa.list_(pa.string())
_CHUNK_ARROW = pa.schema({
    "doc_id": _TEXT, "file_name": _TEXT, "content": _TEXT, "start_line": _INT, "end_line": _INT, "section_path": _TEXTS, "merge": _TEXT, "chunk_index": _INT,
})


def row_by_row(make: Callable[[dict], Iterator[dict]], schema: pa.Schema, weight: str, *, most: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: one row at a time becomes Python objects, and rows made leave when their ``weight`` texts reach ``most`` characters.

    So a worker holds an Arrow batch, whose bytes Spark bounds, and the objects of one document, however many documents a task has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in make(batch.slice(i, 1).to_pylist()[0]):
                    out.append(row)
                    held += 100 + len(row[weight] or "")
                    if held >= most:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def lines(documents: DataFrame, *, max_line_tokens: int = 384, normalize: bool = True) -> DataFrame:
    """doc_id, file_name, line_no, text: normalised lines that are not blank.

    Lines keep their original numbers unless a line of the document had to be split; then all are
    numbered anew.
    """
    raw = documents.select("doc_id", "file_name", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "raw"))
    clean = T.normalize_line(F.col("raw")) if normalize else T.squeeze_line(F.col("raw"))
    # exploded, so that the filter is not moved below and cleaning done once per use
    kept = raw.select("doc_id", "file_name", (F.col("pos") + 1).alias("original_line_no"), F.explode(F.array(clean)).alias("text")).where("text <> ''")
    if max_line_tokens <= 0:
        return kept.withColumnRenamed("original_line_no", "line_no")
    long = (F.length("text") > max_line_tokens) & (T.count_tokens(F.col("text")) > max_line_tokens)
    cut = split_line_udf(max_line_tokens)
    # there is always a part; the outer explode keeps Spark from asking for parts first, which would cut every line twice
    parts = kept.withColumn("parts", F.coalesce(cut(F.when(long, F.col("text"))), F.array("text")))
    by_doc = Window.partitionBy("doc_id", "file_name")
    parts = parts.select(
        "doc_id", "file_name", "original_line_no", F.max(F.size("parts") > 1).over(by_doc).alias("split"), F.posexplode_outer("parts").alias("segment", "text")
    )
    order = by_doc.orderBy("original_line_no", "segment")
    number = F.when(F.col("split"), F.row_number().over(order)).otherwise(F.col("original_line_no"))
    return parts.select("doc_id", "file_name", number.alias("line_no"), "text", "original_line_no", "segment", "split")


def packed(costs: list[int], budget: int, overlap: int = 0, *, least: int = 0) -> Iterator[tuple[int, int | None]]:
    """Ranges of units filled up to a budget, from prefix sums; (i, None) for a unit above it, which is alone.

    A range begins with the last units of the one before that fit the overlap (``least`` of them in any
    case) and holds at least one new unit, so it may exceed the budget by the overlap.
    """
    sums = [0, *accumulate(costs)]
    large = [i for i, c in enumerate(costs) if c > budget]
    first = new = 0
    while new < len(costs):
        if costs[new] > budget:
            yield new, None
            first = new = new + 1
            continue
        at = bisect_left(large, new)
        end = max(new + 1, bisect_right(sums, sums[first] + budget) - 1)
        end = min(end, large[at] if at < len(large) else len(costs))
        yield first, end
        if end == len(costs):
            return
        tail = max(first, min(bisect_left(sums, sums[end] - overlap), end - least)) if overlap > 0 else end
        if costs[end] > budget:
            if least and tail < end:
                yield tail, end
            tail = end
        first, new = tail, end


def pack_words(words: list[str], budget: int, count: Callable[[str], int], overlap: int = 0) -> Iterator[str]:
    """Words joined up to a token budget; a word above it is cut by itself.

    With an overlap, a part begins with the last words of the one before, at least one.
    """
    for a, b in packed([max(1, count(w)) for w in words], budget, overlap, least=1):
        if b is None:
            yield from (words[a][i : i + budget] for i in range(0, len(words[a]), budget))
        else:
            yield " ".join(words[a:b])


def token_counter() -> Callable[[str], int]:
    import re

    find = re.compile(T.TOKEN).findall
    return lambda s: len(find(s))


def split_line_udf(budget: int):
    @F.arrow_udf("array<string>")
    def cut(text: pa.Array) -> pa.Array:
        count = token_counter()
        return T.by_slices(text, lambda s: list(pack_words(s.split(), budget, count)) or [s], _TEXTS)

    return cut


def read(line_rows: DataFrame, locates: DataFrame, *, before: int = 0, after: int = 0) -> DataFrame:
    """locate, file_name, line_no, text: the lines each locate names, with some lines around it."""
    at = locates.select("locate").distinct().withColumn("_p", T.parse_locate(F.col("locate")))
    at = at.select("locate", "_p.file_name", F.explode(F.sequence(F.col("_p.start_line") - before, F.col("_p.end_line") + after)).alias("line_no"))
    return at.join(line_rows.select("file_name", "line_no", "text"), ["file_name", "line_no"]).select("locate", "file_name", "line_no", "text")


def placeholder_rows(line_rows: DataFrame) -> DataFrame:
    found = line_rows.select("doc_id", F.explode(T.placeholders(F.col("text"), F.col("line_no"))).alias("p"))
    return found.select("doc_id", "p.*")


def headings(line_rows: DataFrame, level: Callable[[Column], Column] = T.heading_level, title: Callable[[Column], Column] = T.heading_title) -> DataFrame:
    """doc_id, line_no, level, title; one per (line, title).  level: of a line, null if it is no heading."""
    found = line_rows.select("doc_id", "file_name", "line_no", level(F.col("text")).alias("level"), title(F.col("text")).alias("title"))
    first = Window.partitionBy("doc_id", "line_no", "title").orderBy("level")
    return found.where("level is not null").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def content_ranges(heads: DataFrame, line_rows: DataFrame) -> DataFrame:
    """Adds end_line: the line before the next heading of the same or a higher rank, or the last one.

    The six ranks make "next heading of rank at most r" a window minimum per rank, so no self join.
    """
    last = line_rows.groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    after = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= r, F.col("line_no"))).over(after).alias(f"_n{r}") for r in range(1, 7)]
    out = heads.select("*", *nexts).join(last, "doc_id")
    nxt = F.coalesce(*[F.when(F.col("level") == r, F.col(f"_n{r}")) for r in range(1, 7)])
    end = F.coalesce(nxt - 1, F.col("last_line"))
    return out.withColumn("end_line", F.greatest("line_no", end)).drop("last_line", *[f"_n{r}" for r in range(1, 7)])


def heading_parents(ranged: DataFrame) -> DataFrame:
    """Adds parent_line (null: the root) and section_path.

    The ancestors of a heading are, per smaller rank, the last heading before it that is still open.
    """
    before = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    seen = [
        F.max(F.when(F.col("level") == r, F.struct(F.col("line_no").alias("line"), F.col("title").alias("title"), F.col("end_line").alias("end")))).over(before).alias(f"_p{r}")
        for r in range(1, 7)
    ]
    out = ranged.select("*", *seen)
    open_ = [F.when((F.lit(r) < F.col("level")) & (F.col(f"_p{r}.end") >= F.col("line_no")), F.col(f"_p{r}")) for r in range(1, 7)]
    chain = F.array_sort(F.filter(F.array(*open_), lambda s: s.isNotNull()))
    out = out.withColumn("_chain", chain)
    parent = F.when(F.size("_chain") > 0, F.element_at("_chain", -1)["line"])
    path = F.concat(F.transform("_chain", lambda s: s["title"]), F.array("title"))
    return out.select("doc_id", "file_name", "line_no", "level", "title", "end_line", parent.alias("parent_line"), path.alias("section_path"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """Headings, deepest level and leaves of each document."""
    parents = tree.where("parent_line is not null").select("doc_id", F.col("parent_line").alias("line_no")).distinct().withColumn("inner", F.lit(True))
    marked = tree.join(parents, ["doc_id", "line_no"], "left")
    return marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("level").alias("max_level"), F.count_if(F.col("inner").isNull()).alias("n_leaves")
    )


def chunk(line_rows: DataFrame, tree: DataFrame, *, max_tokens: int = 1200, overlap_tokens: int = 100) -> DataFrame:
    """Chunks guided by the heading tree: a whole section if it fits, else its lines, then its children.

    A section's range holds its children's lines as well, so a large section's text comes twice, and
    lines before the first heading belong to no section.  Order matters inside a document only, so
    documents are rows of ``mapInArrow``.
    """
    body = line_rows.groupBy("doc_id", "file_name").agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "text"))).alias("lines"))
    heads = tree.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("line_no", "end_line", "parent_line")], "section_path"))).alias("heads")
    )
    rows = body.join(heads, "doc_id", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "file_name", "lines", "heads")

    count = token_counter()

    def make(d: dict) -> Iterator[dict]:
        found = document_chunks([(x["line_no"], x["text"]) for x in d["lines"]], d["heads"], d["file_name"], count, max_tokens, overlap_tokens)
        for i, (path, start, end, text, merge) in enumerate(found):
            body = f"{' > '.join(path)}\n\n[CONTENT]\n\n{text}" if path else text
            yield {"doc_id": d["doc_id"], "file_name": d["file_name"], "content": body, "start_line": start, "end_line": end, "section_path": path, "merge": merge, "chunk_index": i}

    return link_chunks(rows.mapInArrow(row_by_row(make, _CHUNK_ARROW, "content"), CHUNK_SCHEMA))


def document_chunks(lines_: list, heads, file_name: str, count, budget: int, overlap: int) -> Iterator[tuple]:
    """(path, start, end, text, merge) of one document in the order of the tree."""
    if not lines_:
        return
    nodes = [(h["line_no"], h["end_line"], h["parent_line"], h["section_path"]) for h in heads] if heads is not None and len(heads) else []
    if not nodes:  # a document without headings is one section named after its file
        nodes = [(lines_[0][0], lines_[-1][0], None, [file_name])]
    numbers, costs = [n for n, _ in lines_], [count(t) for _, t in lines_]
    sums = [0, *accumulate(costs)]
    children: dict = {}
    for node in nodes:
        parent = node[2]
        children.setdefault(None if parent is None or parent != parent else int(parent), []).append(node)
    stack = list(reversed(children.get(None, [])))
    while stack:
        start, end, _, path = stack.pop()
        a, b = bisect_left(numbers, start), bisect_right(numbers, end)
        # a token never spans two lines, so a section's tokens are the sum of its lines'
        if a < b and sums[b] - sums[a] <= budget:
            yield path, start, end, "\n".join(t for _, t in lines_[a:b]), "subtree"
            continue
        for i, j in packed([max(1, c) for c in costs[a:b]], budget, overlap):
            if j is None:
                n, text = lines_[a + i]
                yield from ((path, n, n, piece, "split_long_line") for piece in pack_words(text.split(), budget, count, overlap))
            else:
                part = lines_[a + i : a + j]
                yield path, part[0][0], part[-1][0], "\n".join(t for _, t in part), "split"
        stack.extend(reversed(children.get(start, [])))


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, token_count and the neighbours in order of emission."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    out = chunks.withColumn("chunk_id", F.format_string("%s_c%05d", F.col("doc_id").cast("string"), "chunk_index"))
    return out.withColumns(
        {
            "token_count": T.count_tokens(F.col("content")),
            "prev_chunk_id": F.lag("chunk_id").over(order),
            "next_chunk_id": F.lead("chunk_id").over(order),
        }
    )


def line_windows(line_rows: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` consecutive lines, for flat corpora: one window function, no Python."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    placed = line_rows.withColumn("chunk_index", F.expr(f"(row_number() over (partition by doc_id order by line_no) - 1) div {size}").cast("int"))
    packed = placed.groupBy("doc_id", "file_name", "chunk_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
    )
    return link_chunks(packed)
