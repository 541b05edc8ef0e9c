"""Substring deduplication with fixed-block anchors.

A window is ``WINDOW`` consecutive words of a document; a word is removed if a window that covers it
also starts in a document with a smaller doc_id.

1. Anchors.  Each document's non-overlapping blocks of WINDOW / 2 words are indexed by hash, and every
   rolling window of that many words probes the index.  Any repeat of WINDOW words holds a whole
   block of the earlier document, so no repeat is missed.  Documents send their hashes packed by hash
   bucket (about 5 bytes a window); a bucket answers with the anchors that two documents share, not
   with pairs of documents.
2. Extension.  Around each anchor a document extends the hit to windows of WINDOW words in every
   alignment, and sends those; a bucket keeps the smallest document of each and answers the others.
   The union of a document's answered windows are its maximal repeats, whose words go.

No pair of documents is ever formed, so a passage in n documents costs n messages.  A task answers what
its own documents settle among themselves and sends a bucket only the smallest and the largest document
of each hash (``settled``), so a hot passage costs a bucket one message per task and flush, not one per
document.  The number of buckets follows the bytes of text (``bucket_count``).

Defined results: null and empty text have no words, keep nothing and remove nothing; rows with null
doc_id have no order, so they neither remove nor lose words; rows with equal doc_id do not remove
each other's words; no rows give no rows; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import long_id, table, text_bytes
from corpusloom.llm.words import (
    PACKED, PASS, Gathered, Texts, U, answers, bucket_count, by_bucket, flush_size, found_values, gathered, of_kind, packed_rows, share_of, slices,
    sorted_pairs, to_batch, unpacked,
)

WINDOW = 50
_ANCHOR_BASE, _WINDOW_BASE = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) % U(buckets)).astype(np.int32)


def _anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """What a bucket can answer: bucket number and the low 32 bits."""
    return (_bucket(h, buckets).astype(np.uint64) << U(32)) | (h & U(0xFFFFFFFF))


def _passed(doc: np.ndarray, value: np.ndarray, shares: int) -> list[tuple]:
    return packed_rows(doc, share_of(doc, shares), value, PASS)


def settled(idoc: np.ndarray, ih: np.ndarray, pdoc: np.ndarray, ph: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of one flush: index (kind 0), probes (kind 1) and answers known already.

    A probe is answered by a smaller document's index entry, an entry by a larger document's probe.
    Each hash's smallest entry and largest probe go to its bucket, and so does whatever has no answer.
    """
    idoc, ih, first, _ = sorted_pairs(idoc, ih)
    pdoc, ph, start, end = sorted_pairs(pdoc, ph)
    top = np.iinfo(np.int64)
    if len(ih):
        pos = np.minimum(np.searchsorted(ih[first], ph), len(first) - 1)
        least = np.where(ih[first][pos] == ph, idoc[first][pos], top.max)
    else:
        least = np.full(len(ph), top.max)
    later = pdoc > least
    largest = np.zeros(len(ph), dtype=bool)
    largest[end - 1] = True
    ask = ~later | largest
    if len(ph):
        pos = np.minimum(np.searchsorted(ph[start], ih), len(start) - 1)
        most = np.where(ph[start][pos] == ih, pdoc[end - 1][pos], top.min)
    else:
        most = np.full(len(ih), top.min)
    earlier = most > idoc
    smallest = np.zeros(len(ih), dtype=bool)
    smallest[first] = True
    tell = ~earlier | smallest
    low = lambda h: (h & U(0xFFFFFFFF)).astype(np.uint32)
    rows = packed_rows(idoc[tell], _bucket(ih[tell], buckets), low(ih[tell]), 0)
    rows += packed_rows(pdoc[ask], _bucket(ph[ask], buckets), low(ph[ask]), 1)
    return rows + _passed(np.concatenate([pdoc[later], idoc[earlier]]), _anchor_keys(np.concatenate([ph[later], ih[earlier]]), buckets), buckets)


def anchors(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed index rows, probe rows and answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(4, flush_size(buckets))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for t in slices(batch):
                t.hash_words()
                at, h = t.windows(block, _ANCHOR_BASE)
                doc = ids[t.first + t.doc[at]]
                whole = (at - t.word_at[t.doc[at]]) % block == 0
                if held.add(doc[whole], h[whole], doc, h):
                    yield to_batch(settled(*held.take(), buckets))
        if rest := held.take():
            yield to_batch(settled(*rest, buckets))

    return docs.mapInArrow(run, PACKED)


def shared_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """Answers: anchors of a document that a smaller or a larger document also has."""

    def run(t: pa.Table) -> pa.Table:
        known = of_kind(t, PASS)
        idoc, ih = unpacked(of_kind(t, 0), np.uint32)
        pdoc, ph = unpacked(of_kind(t, 1), np.uint32)
        if not len(ih):
            return known
        bucket = np.uint64(t["bucket"][0].as_py())
        u, where = np.unique(ih, return_inverse=True)
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, where, idoc)
        at = np.minimum(np.searchsorted(u, ph), len(u) - 1)
        hit = u[at] == ph
        pdoc, ph, at = pdoc[hit], ph[hit], at[hit]
        most = np.full(len(u), np.iinfo(np.int64).min)
        np.maximum.at(most, at, pdoc)
        later = pdoc > least[at]
        earlier = most[where] > idoc
        doc = np.concatenate([pdoc[later], idoc[earlier]])
        key = (bucket << U(32)) | np.concatenate([ph[later], ih[earlier]]).astype(np.uint64)
        return pa.concat_tables([known, answers(doc, key, buckets)])

    return by_bucket(packed, buckets).applyInArrow(run, PACKED)


def _member(found: list[np.ndarray | None], t: Texts, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (of windows that begin at words ``at``) their document has been answered."""
    hit = np.zeros(len(at), dtype=bool)
    lo = np.searchsorted(at, t.word_at[:-1])
    hi = np.searchsorted(at, t.word_at[1:])
    for d, f in enumerate(found[t.first : t.last]):
        if f is not None and hi[d] > lo[d]:
            k = keys[lo[d] : hi[d]]
            pos = np.minimum(np.searchsorted(f, k), len(f) - 1)
            hit[lo[d] : hi[d]] = f[pos] == k
    return hit


def extensions(docs: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """Packed windows around shared anchors, each flush's smallest document of each; the others are
    answered.  docs: doc_id, text, found."""

    def told(doc: np.ndarray, h: np.ndarray) -> list[tuple]:
        doc, h, first, _ = sorted_pairs(doc, h)
        smallest = np.zeros(len(h), dtype=bool)
        smallest[first] = True
        rows = packed_rows(doc[smallest], _bucket(h[smallest], buckets), h[smallest], 0)
        return rows + _passed(doc[~smallest], h[~smallest], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(2, flush_size(buckets))
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), found_values(batch.column(2))
            for t in slices(batch):
                t.hash_words()
                at, h = t.windows(block, _ANCHOR_BASE)
                hits = at[_member(found, t, at, _anchor_keys(h, buckets))]
                seen = np.zeros(len(t.h) + 1, dtype=np.int64)
                np.add.at(seen, hits + 1, 1)
                seen = np.cumsum(seen)  # hits before a word
                at, h = t.windows(window, _WINDOW_BASE)
                near = seen[at + window - block + 1] > seen[at]
                if held.add(ids[t.first + t.doc[at[near]]], h[near]):
                    yield to_batch(told(*held.take()))
        if rest := held.take():
            yield to_batch(told(*rest))

    return docs.mapInArrow(run, PACKED)


def repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """Answers: windows of a document that a smaller document also has."""

    def run(t: pa.Table) -> pa.Table:
        doc, h = unpacked(of_kind(t, 0), np.uint64)
        u, where = np.unique(h, return_inverse=True)
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, where, doc)
        later = doc > least[where]
        return pa.concat_tables([of_kind(t, PASS), answers(doc[later], h[later], buckets)])

    return by_bucket(packed, buckets).applyInArrow(run, PACKED)


def _removal(window: int, n_keep: int, digest: bool, source: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = found_values(batch.column(2))
            for t in slices(batch):
                t.hash_words()
                at, h = t.windows(window, _WINDOW_BASE)
                gone = at[_member(found, t, at, h)]
                cover = np.zeros(len(t.h) + 1, dtype=np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                kept = np.cumsum(cover)[:-1] == 0
                # kept words joined by one space: their bytes, and the byte after each but the last
                data = t.data.copy()
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                s, e, d = t.starts[kept], t.ends[kept], t.doc[kept]
                more = np.concatenate([d[1:] == d[:-1], [False]]) if len(d) else np.zeros(0, bool)
                data[e[more]] = 32
                np.add.at(edge, s, 1)
                np.add.at(edge, e + more, -1)
                chosen = np.cumsum(edge)[:-1] > 0
                sizes = np.concatenate([[0], np.cumsum(t.per_doc(chosen))]).astype(np.int64)
                text = data[chosen].tobytes()
                n_removed = t.n_words - np.bincount(d, minlength=t.n)
                columns = [batch.column(0).slice(t.first, t.n), pa.array(t.n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64))]
                if digest:
                    columns.append(pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(sizes[:-1], sizes[1:], strict=True)]))
                else:
                    columns.append(pa.array([text[a:b].decode() for a, b in zip(sizes[:-1], sizes[1:], strict=True)], pa.string()))
                if source:
                    columns.append(batch.column(1).slice(t.first, t.n))
                columns += [batch.column(3 + i).slice(t.first, t.n) for i in range(n_keep)]
                names = ["doc_id", "n_words", "n_removed", "kept", *["source_text"] * source, *[f"_keep_{i}" for i in range(n_keep)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    documents: DataFrame, *, window: int = WINDOW, keep: Sequence[str] = (), digest: bool = False, source: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space, or their sha256),
    source_text if asked for, and the columns in ``keep``, named kept_*."""
    block = window // 2
    fields = [documents.schema[c] for c in keep]
    docs = documents.select(
        long_id(documents), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    )
    known = docs.where(F.col("doc_id").isNotNull())
    buckets = bucket_count(text_bytes(known))
    shared = gathered(shared_anchors(anchors(known.select("doc_id", "text"), block, buckets), buckets), buckets)
    near = known.select("doc_id", "text").join(shared, "doc_id").select("doc_id", "text", "found")
    found = gathered(repeats(extensions(near, window, block, buckets), buckets), buckets)
    kept = [f"_keep_{i}" for i in range(len(keep))]
    whole = known.join(found, "doc_id", "left").select("doc_id", "text", "found", *kept)
    whole = whole.unionByName(docs.where(F.col("doc_id").isNull()).withColumn("found", F.lit(None).cast("binary")))
    ddl = "doc_id long, n_words long, n_removed long, kept string" + ", source_text string" * source + "".join(f", _keep_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    return whole.mapInArrow(_removal(window, len(keep), digest, source), ddl).withColumnsRenamed({f"_keep_{i}": f"kept_{c}" for i, c in enumerate(keep)})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
