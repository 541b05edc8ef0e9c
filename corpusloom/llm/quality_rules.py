"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts by numpy passes over Arrow buffers.  The trees are fitted here with
histogram splits and logistic loss on a bounded sample of labelled documents (``sample_rows`` rows,
the smallest by hash of doc_id), under monotonic constraints: more symbols, repeated lines, repeated
words, capitals or marks can only lower a document's score.  They are flattened to node arrays and
scored for all documents at once: every (document, tree) pair walks down one level per step.

Defined results: null text has no words and fails the base rules; without labels of both classes the
base rules alone decide; no rows give no rows; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import long_id, table
from corpusloom.llm.words import _BYTE, U, Texts, mixed, run_hashes, slices

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct")
STATS = BASE + EXTRA
#: Features and the sign of the constraint on each: -1 means the score may only fall as it rises.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbols_per_word", -1),
    ("dup_lines", -1),
    ("repeat_words", -1),
    ("upper_share", -1),
    ("marks_per_word", -1),
    ("digits_per_word", 0),
    ("distinct_share", 0),
    ("words_per_line", 0),
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOL = _class(b"#*$%&|<>")
_MARK = _class(b"!?|*#$%&")
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _class(bytes(range(48, 58)))


def document_stats(t: Texts) -> dict[str, np.ndarray]:
    h = t.hash_words()
    data, n = t.data, t.n
    chars = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    word_chars = np.bincount(t.doc, weights=sums[t.ends] - sums[t.starts], minlength=n).astype(np.int64)
    out = {"n_words": t.n_words, "word_chars": word_chars}
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = t.per_doc(kind[data])
    # lines: cut at line feeds and at document bounds
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feeds, t.bounds[1:]]))
    starts = np.sort(np.concatenate([feeds + 1, t.bounds[:-1]]))
    line_doc = np.sort(np.concatenate([np.searchsorted(t.bounds, feeds, side="right") - 1, np.arange(n)]))
    with_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    lines = run_hashes(_BYTE[data], starts[with_word], ends[with_word])
    line_doc = line_doc[with_word]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    key = mixed(lines + mixed(line_doc.astype(np.uint64) + U(1)))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)
    # windows of three words found twice or more in a document
    at, w = t.windows(3)
    d = t.doc[at]
    _, where, count = np.unique(mixed(w + mixed(d.astype(np.uint64) + U(1))), return_inverse=True, return_counts=True)
    twice = at[count[where] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(t.doc[covered], minlength=n)
    _, first = np.unique(mixed(h + mixed(t.doc.astype(np.uint64) + U(1))), return_index=True)
    out["n_distinct"] = np.bincount(t.doc[first], minlength=n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    s = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    w = np.maximum(s["n_words"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / w,
            s["n_symbols"] / w,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / w,
            s["n_upper"] / np.maximum(s["n_letters"], 1),
            s["n_marks"] / w,
            s["n_digits"] / w,
            s["n_distinct"] / w,
            s["n_words"] / lines,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Node arrays of all trees: a leaf points to itself, so walking ``depth`` steps always ends there."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit(
    x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 5.0, least: int = 20
) -> Trees:
    """Boosted trees for P(y = 1) with a sign constraint per column of x."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(n, bias)

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        best = (1e-6, None)
        G, H = g[rows].sum(), h[rows].sum()
        for j in range(m):
            b = binned[rows, j]
            size = len(cuts[j]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            if not len(gs):
                continue
            lv, rv = np.clip(-gs / (hs + l2), low, high), np.clip(-(G - gs) / (H - hs + l2), low, high)
            loss = lambda G_, H_, v: G_ * v + 0.5 * (H_ + l2) * v * v
            whole = np.clip(-G / (H + l2), low, high)
            gain = loss(G, H, whole) - loss(gs, hs, lv) - loss(G - gs, H - hs, rv)
            ok = (ns >= least) & (len(rows) - ns >= least) & (signs[j] * (rv - lv) >= 0)
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, lv[k], rv[k]))
        return best[1]

    def grow(rows: np.ndarray, g, h, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([0, np.inf, at, at, rate * value])
        split = best_split(rows, g, h, low, high) if level < depth else None
        if split is None:
            margin[rows] += rate * value
            return at
        j, k, lv, rv = split
        goes = binned[rows, j] <= k
        mid = (lv + rv) / 2
        lb, rb = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
        left = grow(rows[goes], g, h, level + 1, *lb)
        right = grow(rows[~goes], g, h, level + 1, *rb)
        nodes[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -8.0, 8.0))
    f, t, le, r, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(np.int64), t, le.astype(np.int64), r.astype(np.int64), v, np.array(roots), depth, bias)


_STATS_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in STATS]])
_STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for t in slices(batch):
            s = document_stats(t)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(t.first, t.n), *[pa.array(s[c].astype(np.int64)) for c in STATS]], schema=_STATS_ARROW
            )


def train(documents: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000) -> Trees | None:
    """Fit on at most ``sample_rows`` labelled documents, those with the smallest hashes of doc_id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    stats = picked.mapInArrow(_stats, _STATS_DDL).join(chosen, "doc_id").toPandas().sort_values("doc_id")
    y = (stats["quality"].to_numpy() == 1).astype(float)
    if len(y) < 40 or y.min() == y.max():
        return None
    return fit(features({c: stats[c].to_numpy() for c in STATS}), y, [s for _, s in FEATURES])


def judge(documents: DataFrame, model: Trees | None, *, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, score and the columns in ``keep``, named kept_*."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in keep if c != "text"]
    rows = documents.select(long_id(documents), "text", *[F.col(c).alias(f"kept_{c}") for c in extra])
    passed = [*(["text"] if "text" in keep else []), *[f"kept_{c}" for c in extra]]
    names = ["doc_id", *BASE, "base_failed", "kept", "score", *[p if p != "text" else "kept_text" for p in passed]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch):
                s = document_stats(t)
                failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                score = held.value.score(features(s)) if held.value is not None else np.ones(t.n)
                columns = [batch.column(0).slice(t.first, t.n), *[pa.array(s[c].astype(np.int64)) for c in BASE]]
                columns += [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                columns += [batch.column(batch.schema.get_field_index(p)).slice(t.first, t.n) for p in passed]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    for p, n in zip(passed, names[4 + len(BASE) :], strict=True):
        ddl += f", `{n}` {rows.schema[p].dataType.simpleString()}"
    return rows.mapInArrow(run, ddl)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judge(docs, model)
