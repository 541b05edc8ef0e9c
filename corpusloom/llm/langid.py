"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of ``slots`` rows holds the Bloom filters of all languages side by side: bit l of a row is
that row's bit in language l's filter.  An n-gram probes ``hashes`` rows and the AND of them is the
set of all languages that contain it.  A document's count per language is corrected for the filter's
false positives, (hits - n * fp) / (1 - fp) with fp = fill ** hashes, and the largest share decides.

A language's n-grams are those found in its training texts at least ``least`` times and at least
``share`` times as often, per n-gram read, as in the language where they are most frequent; so a few
mislabelled texts or shared n-grams do not blur the filters.  Training reads about ``sample`` documents
per language: those whose hash of doc_id, as a share of all hashes, is below sample / their number.
The filters' size is fixed, so what is collected and broadcast is bounded, and grows by a bit a row
with each language.

Defined results: ``und`` with score 0 for null text, text without a letter and a model without
languages; ties go to the first language by code point; unlabelled rows are only predicted; no rows give
no rows; repeated rows stay, and each counts in training; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, table
from corpusloom.llm.words import U, Texts, mixed, slices

N = 5
_FOLD = np.arange(256, dtype=np.uint64)
for _b in range(256):
    if not (97 <= _b <= 122 or _b >= 128):
        _FOLD[_b] = 32
_P = U(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit value of each n-gram of folded bytes (other than letters: a space).

    Every document is padded with a space at both ends and runs of spaces count as one.
    """
    sizes = np.diff(t.bounds)
    padded = np.full(len(t.data) + 2 * t.n, 32, dtype=np.uint64)
    doc = np.repeat(np.arange(t.n), sizes + 2)
    inner = np.arange(len(t.data)) + np.repeat(2 * np.arange(t.n) + 1, sizes)
    padded[inner] = _FOLD[t.data]
    space = padded == 32
    keep = ~(space & np.concatenate([[False], space[:-1] & (doc[1:] == doc[:-1])]))
    padded, doc = padded[keep], doc[keep]
    m = len(padded) - N + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(N):
        h = h * _P + padded[k : k + m]
    ok = doc[:m] == doc[N - 1 :]
    return doc[:m][ok], mixed(h[ok])


@dataclass
class Filters:
    langs: list[str]
    rows: np.ndarray  # (slots, words of 64 languages)
    hashes: int

    @property
    def fp(self) -> np.ndarray:
        bits = [((self.rows[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(self.langs))]
        return np.minimum(np.array(bits) ** self.hashes, 0.999)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Language mask of each n-gram."""
        out = None
        for k in range(self.hashes):
            slot = ((h >> U(21 * k)) + U(k) * (h >> U(40))) % U(len(self.rows))
            row = self.rows[slot]
            out = row if out is None else out & row
        return out


def build(lists: dict[str, np.ndarray], *, slots: int = 1 << 20, hashes: int = 2) -> Filters:
    langs = sorted(lists)
    rows = np.zeros((slots, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    for i, lang in enumerate(langs):
        h = lists[lang]
        for k in range(hashes):
            slot = ((h >> U(21 * k)) + U(k) * (h >> U(40))) % U(slots)
            rows[slot, i // 64] |= U(1) << U(i % 64)
    return Filters(langs, rows, hashes)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n-gram, count of a partition's texts."""
    held: dict[str, list] = {}

    def rows():
        for lang, parts in held.items():
            h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    size = 0
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for t in slices(batch):
            doc, h = grams(t)
            names = np.array(langs[t.first : t.last], dtype=object)
            for lang in set(names.tolist()):
                u, n = np.unique(h[(names == lang)[doc]], return_counts=True)
                held.setdefault(lang, []).append((u, n))
                size += len(u)
        if size > 4_000_000:
            yield from rows()
            held, size = {}, 0
    yield from rows()


def _slots(gram: Column, k: int, slots: int) -> Column:
    """``Filters.probe``'s k-th row, for a power of two of rows."""
    h = F.shiftrightunsigned(gram, 21 * k) + F.lit(k) * F.shiftrightunsigned(gram, 40)
    return h.bitwiseAND(F.lit(slots - 1))


def kept_grams(documents: DataFrame, *, sample: int = 3000, share: float = 0.2, least: int = 3) -> DataFrame:
    """lang, gram: the n-grams of every language.  documents: doc_id, text (any case), lang."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    unit = F.xxhash64(F.lit(17), "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    rows = rows.join(F.broadcast(sizes), "lang").where(unit * F.col("size") < sample)
    counts = rows.select(F.lower("text").alias("text"), "lang").mapInArrow(_counts, "lang string, gram long, n long")
    counts = stored(counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("gram"))  # a row per language
    return counts.withColumn("top", top).where((F.col("n") >= least) & (F.col("rate") >= share * F.col("top"))).select("lang", "gram")


def train(documents: DataFrame, *, slots: int = 1 << 20, hashes: int = 2, **kept) -> Filters:
    """Filters of all languages; rows of the table are made by the executors and only they are collected."""
    grams = stored(kept_grams(documents, **kept))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    rows = np.zeros((slots, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    if langs:
        number = F.create_map(*[c for i, lang in enumerate(langs) for c in (F.lit(lang), F.lit(i))])[F.col("lang")]
        probes = F.explode(F.array(*[_slots(F.col("gram"), k, slots) for k in range(hashes)]))
        bits = grams.select(number.alias("i"), probes.alias("slot"))
        bits = bits.groupBy("slot", F.floor(F.col("i") / 64).cast("int").alias("word"))
        found = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % 64)).alias("mask")).toArrow()
        rows[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Filters(langs, rows, hashes)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def decide(t: Texts, model: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language and its share of all corrected counts, per document."""
    doc, h = grams(t)
    n = np.bincount(doc, minlength=t.n)
    masks = model.probe(h)
    fp = model.fp
    est = np.zeros((t.n, len(model.langs)))
    for i in range(len(model.langs)):
        hit = (masks[:, i // 64] >> U(i % 64)) & U(1)
        hits = np.bincount(doc, weights=hit.astype(np.float64), minlength=t.n)
        est[:, i] = np.maximum((hits - n * fp[i]) / (1 - fp[i]), 0)
    best = est.argmax(axis=1)
    top = est[np.arange(t.n), best]
    return best, np.clip(top / np.maximum(est.sum(axis=1), 1e-12), 0, 1)


def predict(documents: DataFrame, model: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score; reads doc_id and text only."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lower(F.coalesce("text", F.lit(""))).alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*held.value.langs, "und"], dtype=object)
        for batch in batches:
            for t in slices(batch):
                letters = np.asarray(batch.column(3).slice(t.first, t.n).to_numpy(zero_copy_only=False), dtype=bool)
                if len(names) > 1:
                    best, score = decide(t, held.value)
                else:
                    best, score = np.zeros(t.n, int), np.zeros(t.n)
                best = np.where(letters, best, len(names) - 1)
                score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.n), batch.column(2).slice(t.first, t.n), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    schema=_OUT,
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model)
