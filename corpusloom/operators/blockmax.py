"""A stored inverted index with block maxima, and BM25 top-k that opens only blocks which can matter.

Documents are cut in blocks of neighbours.  A row per token and block holds the block's documents with that token, what each
would score, and the highest of these scores; rows lie in folders by a hash of the token, sorted by token.  A search first
reads the maxima of its tokens: their weighted sum bounds every document of a block.  The most promising blocks of each query
are scored; of the others only those whose bound reaches the k-th score found so far.  Scores equal ``retrieval.bm25_top_k``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import top_k

BLOCK_DOCS = 256
FOLDERS = 32
#: Above what sums of doubles in another order differ by.
MARGIN = 1e-9


@dataclass(frozen=True)
class Index:
    """``postings``: token, block, ids, parts, most, folder; ``tokens``: token, df; ``documents``: how many have a token."""

    postings: DataFrame
    tokens: DataFrame
    documents: int
    folders: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (token, block, ids, tfs, dls) of the blocks of a task; a row without token holds a block's documents and words."""
    names = ["token", "block", "ids", "tfs", "dls"]

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.take(pa.compute.sort_indices(rows["id"])).combine_chunks()
        ids, lists = rows["id"].combine_chunks(), rows["w"].combine_chunks()
        dl = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        cell, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        which, own = np.divmod(cell, len(dl))
        # the dictionary's codes all occur, so they are the rows
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(which))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(own)), pa.array(tf.astype(np.int32)), pa.array(dl[own]))]
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(ends) - 1, number)), *lists], names=names)

    def total(rows: pa.Table, number: int) -> pa.RecordBatch:
        words = pa.compute.sum(pa.compute.list_value_length(rows["w"])).as_py()
        row = [pa.array([None], pa.string()), pa.array([number]), pa.array([[]], pa.list_(rows["id"].type)), *[pa.array([[x]], pa.list_(pa.int32())) for x in (rows.num_rows, words)]]
        return pa.RecordBatch.from_arrays(row, names=names)

    left = None
    for batch in itertools.chain(batches, [None]):
        rows = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        if rows is None or not rows.num_rows:
            continue
        numbers = rows["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1), rows.num_rows]
        last = len(cuts) - (1 if batch is None else 2)  # the last block may go on in the next batch
        for i, j in zip(cuts[:last], cuts[1 : last + 1], strict=True):
            part = rows.slice(i, j - i)
            yield block(part, numbers[i])
            yield total(part, numbers[i])
        left = rows.slice(cuts[last])


def write(docs: DataFrame, path: str, *, tokens=T.standard_tokens, k1: float = 1.2, b: float = 0.75, block_docs: int = BLOCK_DOCS, folders: int = FOLDERS) -> None:
    """Writes the index of docs (id, text) to a folder that must not exist; documents without a token are not in it.

    A block lies in one task, which counts its words; only postings are stored and dealt by range, no text.  A block is bounded by its
    number of documents, so a token that stands everywhere is many rows, dealt with all others.
    """
    numbered = docs.select("id", tokens(F.col("text")).alias("w"), F.expr(f"monotonically_increasing_id() div {block_docs}").alias("block")).where(F.size("w") > 0)
    kind = docs.schema["id"].dataType.simpleString()
    made = f"token string, block long, ids array<{kind}>, tfs array<int>, dls array<int>"
    numbered.mapInArrow(_counted, made).write.parquet(f"{path}/counts")
    held = docs.sparkSession.read.schema(made).parquet(f"{path}/counts")
    n, words = held.where("token is null").agg(F.sum(F.col("tfs")[0]), F.sum(F.col("dls")[0])).first()
    average = F.lit(words / n if n else 1.0)
    parts = F.zip_with("tfs", "dls", lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)))
    rows = held.where("token is not null").select("token", "block", "ids", parts.alias("parts")).withColumn("most", F.array_max("parts"))
    rows = rows.withColumn("folder", F.pmod(F.xxhash64("token"), F.lit(folders)).cast("int"))
    by = ["folder", "token", "block"]  # ranges, so that a folder or a token may take many tasks
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("folder").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings") if n else rows
    stored.groupBy("token").agg(F.sum(F.size("ids")).alias("df")).write.parquet(f"{path}/tokens")
    docs.sparkSession.range(1).select(F.lit(n or 0).alias("documents"), F.lit(folders).alias("folders")).write.parquet(f"{path}/size")


def read(spark: SparkSession, path: str) -> Index:
    tokens = spark.read.parquet(f"{path}/tokens")
    documents, folders = spark.read.parquet(f"{path}/size").select("documents", "folders").first()
    if not documents:
        return Index(spark.createDataFrame([], "token string, block long, ids array<string>, parts array<double>, most double, folder int"), tokens, 0, folders)
    return Index(spark.read.parquet(f"{path}/postings"), tokens, documents, folders)


def asked_tokens(index: Index, queries: DataFrame, tokens=T.standard_tokens) -> DataFrame:
    """query_id, token, weight of the tokens that the index knows."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))
    idf = F.log1p((F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.tokens, "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"))


def opened(index: Index, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, id, score of all documents in the blocks (query_id, block) that have a token of the query."""
    wanted = blocks.select("query_id", "block").join(asked, "query_id")
    hits = index.postings.select("token", "block", "ids", "parts").join(wanted, ["token", "block"])
    rows = hits.select("query_id", "weight", F.inline(F.arrays_zip("ids", "parts")))
    return rows.groupBy("query_id", F.col("ids").alias("id")).agg(F.sum(F.col("weight") * F.col("parts")).alias("score"))


def best_of_blocks(index: Index, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, id, score as ``opened`` has them, of what can be among a query's k best: a block's best k, and of those what reaches ``least``.

    blocks: query_id, block, least (null if unknown).  A block's postings meet in one task as they are stored, once for all queries; no document
    is a row but those returned.
    """
    wanted = asked.groupBy("token").agg(F.collect_list(F.struct("query_id", "weight")).alias("asks"))
    hits = index.postings.select("token", "block", "ids", "parts").join(wanted, "token").join(blocks.select("block").distinct(), "block", "left_semi")
    kinds = {"query_id": blocks.schema["query_id"].dataType.simpleString(), "id": index.postings.schema["ids"].dataType.elementType.simpleString()}

    def best(t: pa.Table, b: pa.Table) -> pa.Table:
        rows = {q: i for i, q in enumerate(b["query_id"].to_pylist())}
        ids = pa.concat_arrays(c.flatten() for c in t["ids"].chunks).dictionary_encode() if t.num_rows else pa.array([], t.schema.field("ids").type.value_type).dictionary_encode()
        found = np.zeros((len(rows), len(ids.dictionary)))
        at, parts = ids.indices.to_numpy(), np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in t["parts"].chunks)])
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(t["ids"]).to_numpy())]).astype(int)
        for i, asks in enumerate(t["asks"].to_pylist()):
            own = [(rows[a["query_id"]], a["weight"]) for a in asks if a["query_id"] in rows]
            if own:
                part = slice(ends[i], ends[i + 1])
                who, weight = (np.array(x) for x in zip(*own, strict=True))
                found[np.ix_(who, at[part])] += weight[:, None] * parts[part]
        least = b["least"].to_numpy()
        low = np.where(np.isnan(least), 0.0, least - 2 * MARGIN)
        if found.shape[1] > k and len(rows):  # equal ones, to the digits that are compared, all stay
            low = np.maximum(low, np.partition(found, found.shape[1] - k, axis=1)[:, -k] - 2 * MARGIN)
        q, i = np.nonzero((found > 0) & (found >= low[:, None]))
        return pa.table({"query_id": b["query_id"].combine_chunks().take(pa.array(q)), "id": ids.dictionary.take(pa.array(i)), "score": found[q, i]})

    blocks = blocks.select("query_id", "block", F.col("least").cast("double").alias("least"))
    return hits.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def bounds(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, block, bound: what no document of the block exceeds.  Reads maxima only."""
    heads = index.postings.select("token", "block", "most").join(asked, "token")
    return heads.groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def search(index: Index, queries: DataFrame, k: int, *, checkpoint, first: int = 2, digits: int = 9, tokens=T.standard_tokens) -> tuple[DataFrame, DataFrame]:
    """The k best of every query (query_id, id, score, rank), and per query how many blocks had a token and were opened.

    first: blocks scored before any is skipped.
    """
    # folders without an asked token are never listed; the number of folders is a parameter
    asked = checkpoint(asked_tokens(index, queries, tokens))
    wanted = [r[0] for r in asked.select(F.pmod(F.xxhash64("token"), F.lit(index.folders)).cast("int")).distinct().collect()]
    index = replace(index, postings=index.postings.where(F.col("folder").isin(wanted)))
    reach = checkpoint(bounds(index, asked))
    ranked = top_k(reach, first, order=[F.desc("bound"), "block"])
    start = checkpoint(ranked.select("query_id", "block"))
    found = checkpoint(best_of_blocks(index, asked, start.withColumn("least", F.lit(None)), k))
    least = top_k(found, k, order=[F.desc("score"), "id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = reach.join(start, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    rest = checkpoint(rest.where(F.col("least").isNull() | (F.col("bound") + MARGIN >= F.col("least"))).select("query_id", "block", "least"))
    hits = found.unionByName(best_of_blocks(index, asked, rest, k))
    best = top_k(hits, k, order=[F.desc(F.round("score", digits)), "id"])
    counts = reach.select("query_id", F.lit(1).alias("blocks"), F.lit(0).alias("opened"))
    counts = counts.unionByName(start.unionByName(rest.drop("least")).select("query_id", F.lit(0).alias("blocks"), F.lit(1).alias("opened")))
    return best, counts.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("opened").alias("opened"))
