"""Vectorised words and hashes over Arrow text columns.

A column of UTF-8 text is one byte array with offsets, so words, lines and hashes of many documents
are found by a few numpy passes without a Python loop over words.  The hash of a byte run is a
polynomial over the ring of 64-bit integers with random byte values: prefix sums give the hash of any
run by one subtraction and one multiplication, and a finaliser mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, size=256, dtype=np.uint64, endpoint=True)
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; a longer document is handled alone.
SLICE = 1 << 19
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i mod 2**64 for i < n (or of its inverse); the table is kept while it is of usual size."""
    held = _powers.get((base, inverse))
    if held is None or len(held) < n:
        b = pow(base, -1, 2**64) if inverse else base
        held = np.full(max(n, SLICE + 1), b, dtype=np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if n <= 4 * SLICE:
            _powers[base, inverse] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[s:e] (64-bit values) for every s, e."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(base, len(values) + 1, inverse=True)[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


class Texts:
    """Documents first..last of a batch: bytes and the bounds of each document in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, last: int, lower: bool = False):
        self.data, self.bounds, self.first, self.last = data, bounds, first, last
        if lower:
            self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.n = last - first

    def find_words(self) -> None:
        """starts, ends, doc: byte range and document number of each word."""
        word = ~_WHITE[self.data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        cuts = self.bounds[:-1][self.bounds[:-1] < len(word)]
        before[cuts] = False
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(self.bounds, self.starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        #: The first word of each document, and one past the last.
        self.word_at = np.concatenate([[0], np.cumsum(self.n_words)])

    def hash_words(self) -> np.ndarray:
        self.find_words()
        self.h = run_hashes(_BYTE[self.data], self.starts, self.ends)
        return self.h

    def windows(self, k: int, base: int = _BASE2) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every k consecutive words of one document."""
        at = np.arange(max(0, len(self.h) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, run_hashes(self.h, at, at + k, base)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte in each document."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def slices(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[Texts]:
    """The batch in runs of documents of at most SLICE bytes.  Null text has no bytes."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1
        last = min(max(last, first + 1), len(text))
        yield Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, last, lower)
        first = last


# --- rows per hash bucket -------------------------------------------------------------------------

#: One row holds what a run of documents sends to one bucket: document ids, how many values each
#: sends, and the values.
PACKED = "bucket int, kind int, docs binary, counts binary, vals binary"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("vals", pa.binary())]
)
#: Bytes of text whose messages make up a bucket, the least number of buckets, and the number from which
#: it grows with the square root only, so that a task still has many values for each.
BUCKET_BYTES, BUCKETS, MANY_BUCKETS = 1 << 24, 8, 1 << 15
#: Kind of the rows that are answers already: their bucket is a share, and buckets pass them on.
PASS = 9


def bucket_count(text_bytes: int) -> int:
    """Buckets follow the input, so the memory of one does not (16 MB of text each up to 512 GB)."""
    n = max(BUCKETS, -(-text_bytes // BUCKET_BYTES))
    return n if n <= MANY_BUCKETS else int((n * MANY_BUCKETS) ** 0.5)


def flush_size(buckets: int) -> int:
    """Values gathered before rows are sent."""
    return min(1 << 23, max(1 << 20, 32 * buckets))


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative numbers in the fewest bytes each that hold them all, after that number."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _widened(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def packed_rows(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, kind: int) -> list[tuple]:
    """Rows (bucket, kind, docs, counts, vals); values of one document stand together."""
    order = np.lexsort((doc, bucket))
    doc, bucket, value = doc[order], bucket[order], value[order]
    if not len(doc):
        return []
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(doc)]]))
    heads, head_bucket = doc[at].astype(np.int64), bucket[at]
    cut = np.concatenate([[0], np.flatnonzero(head_bucket[1:] != head_bucket[:-1]) + 1, [len(at)]])
    ends = np.concatenate([at, [len(doc)]])
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        gaps = (heads[a + 1 : b].view(np.uint64) - heads[a : b - 1].view(np.uint64)).astype(np.uint64)
        ids = heads[a : a + 1].tobytes() + _narrow(gaps)
        out.append((int(head_bucket[a]), kind, ids, _narrow(runs[a:b]), value[ends[a] : ends[b]].tobytes()))
    return out


def to_batch(rows: list[tuple], schema: pa.Schema = PACKED_ARROW) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unpacked(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """doc and value of all rows of a bucket."""
    docs, values = [np.zeros(0, np.int64)], [np.zeros(0, dtype)]
    for d, c, v in zip(table["docs"].to_pylist(), table["counts"].to_pylist(), table["vals"].to_pylist(), strict=True):
        ids = np.cumsum(np.concatenate([np.frombuffer(d, np.int64, count=1), _widened(d[8:])]))
        docs.append(np.repeat(ids, _widened(c)))
        values.append(np.frombuffer(v, dtype))
    return np.concatenate(docs), np.concatenate(values)


def of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table["kind"].to_numpy() == kind))


def by_bucket(packed, buckets: int):
    """Packed rows grouped by bucket, in as many tasks as there are buckets."""
    return packed.repartitionById(buckets, "bucket").groupBy("bucket")


def sorted_pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by hash and document, and where each hash's pairs begin and end."""
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    return doc, h, at, np.concatenate([at[1:], [len(h)]])[: len(at)]


class Gathered:
    """Columns of values held until there are enough of them."""

    def __init__(self, n: int, enough: int):
        self.enough, self.columns, self.size = enough, [[] for _ in range(n)], 0

    def add(self, *columns: np.ndarray) -> bool:
        """Whether it is time to take them."""
        for held, c in zip(self.columns, columns, strict=True):
            held.append(c)
        self.size += max(map(len, columns))
        return self.size >= self.enough

    def take(self) -> list[np.ndarray] | None:
        out = [np.concatenate(c) for c in self.columns] if self.columns[0] else None
        self.columns, self.size = [[] for _ in self.columns], 0
        return out


# --- answers to documents -------------------------------------------------------------------------


def share_of(doc: np.ndarray, shares: int) -> np.ndarray:
    """Share of the documents in which answers to a document meet."""
    return (mixed(doc.astype(np.uint64)) % U(shares)).astype(np.int32)


def answers(doc: np.ndarray, value: np.ndarray, shares: int) -> pa.Table:
    """Values of 64 bits to documents, packed by share."""
    return pa.Table.from_batches([to_batch(packed_rows(doc, share_of(doc, shares), value, 0))])


def gathered(packed, shares: int):
    """doc_id, found: the distinct values sent to each document, sorted, in one binary."""

    def run(t: pa.Table) -> pa.Table:
        doc, value = unpacked(t, np.uint64)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new], value[new]
        cut = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
        found = [value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
        return pa.table({"doc_id": pa.array(doc[cut[:-1]] if len(doc) else doc, pa.int64()), "found": pa.array(found, pa.binary())})

    return by_bucket(packed, shares).applyInArrow(run, "doc_id long, found binary")


def found_values(column: pa.Array) -> list[np.ndarray | None]:
    """Per document the sorted values of its answers, or None."""
    return [np.frombuffer(f, np.uint64) if f else None for f in column.to_pylist()]
