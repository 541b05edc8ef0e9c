"""Quality classifier by importance resampling (hashed n-gram models, Gumbel top-k).

Two generative models count hashed unigrams and bigrams of words in ``buckets`` buckets: the raw model
over all documents, the target model over all documents labelled good and not toxic.  Their ids come to
the documents in blocks of about ``block_rows``, each a broadcast of bounded size, and texts are not
shuffled; every block after the first reads the documents once more.  A document's weight is the
logarithm of its likelihood ratio, the sum over its n-grams of log target - log raw.  Adding Gumbel noise
seeded by doc_id and text and keeping the k largest samples k documents without replacement in
proportion to target / raw.  k is ``fraction`` of all documents, by default the share of good ones among
the labelled.  ``length_fair`` divides the weight by the number of n-grams and multiplies it by that
number, so that long and short documents compete alike; it is no likelihood ratio and not the default.

The k-th largest key is found without sorting all rows in one task: keys are counted in 4096 bins between
the least and the largest, the bin that holds rank k is cut again, and so on until few rows are left.

Defined results: null and empty texts have no n-grams, weigh ``LOWEST`` and come last; ties (equal keys,
from repeated rows) are all kept if the first of them is; without good labels every weight is zero and
every document is kept; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table
from corpusloom.llm.words import U, Texts, mixed, slices

BUCKETS = 1 << 17
#: Weight of a document without n-grams, below any sum.
LOWEST = -1e15
SEED = 11


def hashed_grams(t: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every word and every pair of neighbouring words."""
    h = t.hash_words()
    at, pairs = t.windows(2)
    doc = np.concatenate([t.doc, t.doc[at]])
    return doc, (np.concatenate([h, mixed(pairs)]) % U(buckets)).astype(np.int64)


def counted(documents: DataFrame, flag: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all documents and over those whose flag is true.

    A task sends a row per bucket it has seen; buckets are summed apart and only the sums are collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for t in slices(batch):
                doc, b = hashed_grams(t, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[t.first : t.last][doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        for at in range(0, len(some), 1 << 14):
            i = some[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(raw[i]), pa.array(target[i])], names=["bucket", "raw", "target"])

    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"), flag).mapInArrow(run, "bucket int, raw long, target long")
    sums = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, buckets), np.int64)
    for o, c in zip(out, ("raw", "target"), strict=True):
        o[sums["bucket"].to_numpy()] = sums[c].to_numpy()
    return out[0], out[1]


def ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log target - log raw per bucket; an empty target model gives zeros."""
    if not target.sum():
        return np.zeros(len(raw))
    log = lambda c: np.log((c + smooth) / (c.sum() + smooth * len(c)))
    return log(target) - log(raw)


def weigh(documents: DataFrame, ratio: np.ndarray, length_fair: float | None, seed: int) -> DataFrame:
    """doc_id, weight, key (weight plus Gumbel noise)."""
    held = documents.sparkSession.sparkContext.broadcast(ratio)
    unit = (F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (-F.log(-F.log(unit))).alias("noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch):
                doc, b = hashed_grams(t, len(held.value))
                n = np.bincount(doc, minlength=t.n)
                w = np.bincount(doc, weights=held.value[b], minlength=t.n)
                if length_fair is not None:
                    w = w / np.maximum(n, 1) * length_fair
                w = np.where(n > 0, w, LOWEST)
                noise = batch.column(2).slice(t.first, t.n).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(w), pa.array(w + noise)], names=["doc_id", "weight", "key"])

    return rows.mapInArrow(run, "doc_id long, weight double, key double")


def top_k(rows: DataFrame, k: int, *, bins: int = 4096, few: int = 1 << 16) -> DataFrame:
    """Adds kept: the key is among the k largest (and those equal to the last)."""
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    keys = rows.select("key")
    # documents without n-grams would stretch the bins: they only come in once the others are used up
    filled = keys.where(F.col("key") > LOWEST / 2)
    n = filled.count()
    inside, need = (filled, k) if n >= k else (keys.where(F.col("key") <= LOWEST / 2), k - n)
    low, high, n = inside.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if n < need:
        return rows.withColumn("kept", F.lit(True))
    while n > few and low < high:
        at = F.least(F.floor((F.col("key") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
        counts = inside.groupBy(at.alias("bin")).agg(F.min("key"), F.max("key"), F.count(F.lit(1))).collect()
        for _, low, high, n in sorted(counts, reverse=True):
            if n >= need:
                break
            need -= n
        inside = inside.where(F.col("key").between(low, high))
    last = low if low == high else inside.orderBy(F.desc("key")).limit(need).agg(F.min("key")).first()[0]
    return rows.withColumn("kept", F.col("key") >= F.lit(last))


def resample(
    documents: DataFrame,
    labels: DataFrame,
    *,
    fraction: float | None = None,
    block_rows: int = 1 << 20,
    buckets: int = BUCKETS,
    length_fair: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, weight, key, kept."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.min(F.coalesce("quality", F.lit(0))) == 1).alias("good"), (F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("bad")
    )
    marks = stored(marks)
    wanted = F.col("good") & ~F.col("bad")
    seen, good, n = marks.agg(F.count(F.lit(1)), F.count_if(F.col("good")), F.count_if(wanted)).first()
    flags = marks.where(wanted).select("doc_id", F.lit(True).alias("target"))
    blocks = max(1, -(-n // block_rows))
    block = [F.broadcast(flags.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)) for i in range(blocks)]
    if fraction is None:
        fraction = good / seen if seen and good else 1.0
    docs = documents.select("doc_id", "text")
    raw, target = counted(docs.join(block[0], "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), "target", buckets)
    for more in block[1:]:
        target = target + counted(docs.join(more, "doc_id").select("text", "target"), "target", buckets)[1]
    rows = stored(weigh(docs, ratios(raw, target), length_fair, seed))
    return top_k(rows, int(round(fraction * rows.count())))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"))
