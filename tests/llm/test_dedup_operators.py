"""Substring dedup, Jaccard join, nearest neighbours, components and the pipeline."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import graphs, hilbert, jaccard, substring
from tests.llm.common import LOWER, ODD, frame, prose, words


def corpus(seed):
    """Copies, near copies, shared passages, a hot group, odd rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 260)) for _ in range(40)]
    passage = prose(rng, 80)
    texts = list(base)
    for b in base[:15]:
        w = b.split()
        for _ in range(3):
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += [base[0]] * 12 + [base[1].upper()] * 2
    texts += [prose(rng, 60) + " " + passage + "\n" + prose(rng, 30) for _ in range(15)]
    texts += [passage + " " + passage, " ".join(passage.split()[:49]), " ".join(passage.split()[:50])]
    rng.shuffle(texts)
    return texts + ODD + ["a b c d", "A B c D"]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = frame(spark, texts, first=100, found="clash", kept="clash")
    out = {r["doc_id"]: r for r in substring.remove_repeats(df, keep=("lang",), source=True).collect()}
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        cover = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                cover[k : k + 50] = [True] * 50
        r = out[100 + i]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(cover))
        assert r["kept"] == " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        assert r["kept_lang"] == "en" and r["source_text"] == (t or "")
    digest = substring.remove_repeats(df, digest=True).where("doc_id = 100").first()
    assert digest["kept"] == hashlib.sha256(out[100]["kept"].encode()).hexdigest()


def test_texts_longer_than_a_slice(spark):
    """A text above the bytes handled at once, and one whose table of powers is not kept."""
    rng = random.Random(12)
    big = prose(rng, 150_000, 100_000)
    huge = prose(rng, 400_000, 100_000)
    assert len(big) > 1 << 19 and len(huge) > 1 << 21
    texts = [big, prose(rng, 100) + " " + " ".join(big.split()[:60_000]), huge, huge + " tail", prose(rng, 80)]
    out = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(frame(spark, texts)).collect()}
    assert out == {0: 0, 1: 60_000, 2: 0, 3: 400_000, 4: 0}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(frame(spark, texts)).collect()}
    sets, roots = all_pairs(texts)
    assert got == {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, roots, strict=True))}


def test_substring_odd_tables(spark):
    long = " ".join(f"v{i}" for i in range(120))
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (None, None), (7, long)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert out == [(-1, 0), (-1, 0), (5, 0), (5, 0), (7, 120)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def all_pairs(texts):
    """Shingle sets and the smallest linked number of each text, by comparing every pair."""
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed,task", [(1, 1_500_000), (2, 2_000)])
def test_jaccard_against_all_pairs(spark, seed, task):
    texts = corpus(seed)
    df = frame(spark, texts, first=7, n="clash", component="clash")
    out = {r["doc_id"]: r for r in jaccard.similar_classes(df, task_shingles=task).collect()}
    sets, roots = all_pairs(texts)
    for i, s in enumerate(sets):
        assert out[7 + i]["n_shingles"] == len(s)
        assert out[7 + i]["component_id"] == 7 + roots[i]


def test_jaccard_split_group_of_many_small_classes(spark):
    """Documents put together from few passages: one group by prefixes, of many classes and sizes."""
    rng = random.Random(4)
    passages = [prose(rng, rng.randrange(20, 60), 2000) for _ in range(14)]
    texts = [" ".join(rng.sample(passages, rng.randrange(2, 8))) for _ in range(120)]
    texts += [t + " " + prose(rng, 6) for t in texts[:40]]
    sets, roots = all_pairs(texts)
    classes = len(set(roots))
    assert 20 < classes < 140
    for task in (600, 5_000, 1_500_000):
        out = {r["doc_id"]: r["component_id"] for r in jaccard.similar_classes(frame(spark, texts), task_shingles=task).collect()}
        assert out == dict(enumerate(roots))


def test_jaccard_equal_low_hash_bits_lose_no_share(spark):
    """Two shingles of one document that look equal in a bucket both count, if another document has one."""
    from corpusloom.llm.words import PACKED, packed_rows

    doc, h = np.array([1, 1, 2, 3, 3, 4]), np.array([5, 5, 5, 6, 6, 7], dtype=np.uint32)
    rows = packed_rows(doc, np.zeros(6, int), h, jaccard._ONE) + packed_rows(np.zeros(1, int), np.zeros(1, int), h[-1:], jaccard._MANY)
    rows += jaccard._rep_rows(np.arange(1, 5), np.array([2, 1, 2, 1]), np.arange(1, 5), 8)
    got = {r["doc_id"]: r["shared"] for r in jaccard.shared_counts(spark.createDataFrame(rows, PACKED), 8).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 1}


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.similar_classes(df).collect())
    assert out == [(-1, 0, -1), (3, 2, 3), (4, 0, 4), (5, 2, 3), (5, 2, 3)]
    assert jaccard.similar_classes(df.limit(0)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(999, 110)]
    df = spark.createDataFrame([*path, *star, (5, 5), (40, 39)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(100, 130), 999], 100)}
    assert graphs.components(df.limit(0)).count() == 0


def test_hilbert_curve_is_a_walk():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = hilbert.nearest(df, F.col("vec_id") % 20 == 0, task_rows=256).toPandas()
    y = x.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        s = np.einsum("d,nd->n", y[q], y)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert mine["score"].tolist() == [np.einsum("d,d->", y[q], y[v]) for v in mine["vec_id"]]
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits / (75 * 20) >= 0.9
    # groups of few queries find the same, also where many stand in one segment
    every = lambda **how: sorted(map(tuple, hilbert.nearest(df.where("vec_id < 600"), F.col("vec_id") % 3 == 0, **how).collect()))
    assert every(task_rows=128, task_queries=5) == every(task_rows=128)
    few = hilbert.nearest(df.where("vec_id < 5 or vec_id >= 2000"), F.col("vec_id") == 0).toPandas()
    assert sorted(few["vec_id"]) == [1, 2, 3, 4]
    assert hilbert.nearest(df.limit(0), F.lit(True)).count() == 0
    assert hilbert.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [t for t in corpus(3) if len(words(t)) >= 50] + [None, "short", "# * $ % & " * 30]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    labels.write.parquet(os.path.join(tmp_path, "labels.parquet"))
    d = f"file://{tmp_path}"
    at = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, d)
        at.write.parquet(path := os.path.join(tmp_path, name.replace(" ", "_")))
        at = spark.read.parquet(path)
        seen.append(at)
    assert [s.schema == docs.schema for s in seen] == [True, True, True, True, False]
    kept = {r["doc_id"] for r in seen[0].collect()}
    assert len(texts) - 2 not in kept and len(texts) - 1 not in kept and len(kept) >= len(texts) - 4
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.similar_classes(seen[0]).collect()}
    assert {r["doc_id"] for r in seen[1].collect()} == set(classes.values())
    again = {r["doc_id"]: r for r in substring.remove_repeats(seen[1]).collect()}
    for r in seen[2].collect():
        assert r["text"] == (again[r["doc_id"]]["kept"] if again[r["doc_id"]]["n_removed"] else texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    sizes = {r["doc_id"]: len(words(r["text"])) for r in seen[2].collect()}
    mixed = {}
    for r in seen[3].collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(words(r["text"]))
    assert all(n <= 3 * sizes[i] for i, n in mixed.items())
    assert abs(sum(mixed.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values()) + 200
    tokens = seen[4].collect()
    assert len(tokens) == seen[3].count() and all(r["round_trip"] for r in tokens)
    assert corpus_pipeline.run(spark, d).count() == len(tokens)


def test_pipeline_odd_tables(spark, tmp_path):
    """Repeated and null ids, ties, extra columns with clashing names, no labels, empty tables."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = [prose(rng, 90) for _ in range(6)]
    data = [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)]
    data += [(2, texts[5] + " more", None, None, None, None, 2), (2, texts[2], "de", "a", 1, "y", 3), (None, texts[1], "en", "s", 1, "z", 4), (9, None, None, None, None, None, None), (10, texts[3], None, "s", 3, "w", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string, n_words long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("full", docs), ("empty", docs.limit(0))):
        at = os.path.join(tmp_path, name)
        df.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
    d = f"file://{tmp_path}/full"
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert kept.columns == docs.columns and kept.where("doc_id = 9").isEmpty()
    runs = []
    for parts in (1, 5):
        found = corpus_pipeline.STAGES[1][1](spark, kept.repartition(parts), d)
        assert found.columns == docs.columns
        runs.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["size"] or "") for r in found.collect()))
    assert runs[0] == runs[1]
    ids = [r[1] for r in runs[0] if not r[0]]
    assert len(ids) == len(set(ids)) and 10 not in ids and 3 in ids
    assert sum(r[0] for r in runs[0]) == 1
    a, b = (sorted((r["doc_id"] or -1, r["ids"]) for r in corpus_pipeline.run(spark, d).collect()) for _ in range(2))
    assert a == b and a
