"""Substring counts, keyword scores and the stored index against plain restatements."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import blockmax as X
from corpusloom.operators import memory as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import substrings as A
from corpusloom.plans.tables import stored


def texts(seed, n=120):
    rng = random.Random(seed)
    out = ["".join(rng.choice("abAB \n") for _ in range(rng.randrange(80))) for _ in range(n)]
    return out + [None, "", "aaaaaaa", "ab" * 30_000, "naïve ñandú 漢字 漢字漢", "a.b(c"]


def test_occurrences_equal_counts(spark):
    rows = list(enumerate(texts(1)))
    names = ["a", "aa", "aba", "ab", "b a", "AB", "漢", "漢字", "ñ", ".b(", "zzz", "", None, "aa", "a" * 8]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(i, n, t.count(n)) for i, t in rows if t for n in names if n and n in t}
    for block in (2, 1 << 16):
        got = A.occurrences(df, known, block=block).collect()
        assert len(got) == len(want) and {(r["id"], r["name"], r["n"]) for r in got} == want
    assert A.occurrences(df, known.limit(0)).count() == 0 and A.occurrences(df.limit(0), known).count() == 0


def test_occurrence_bonus_of_many_names(spark):
    chunks = [("c1", "Ann met ann and Bo"), ("c2", "annex"), ("c3", None), ("c4", "nobody")]
    entities = spark.createDataFrame([("e1", "Ann"), ("e2", "BO"), ("e3", "ann")], "entity_id string, name string")
    got = {(r["entity_id"], r["chunk_id"]): r["bonus"] for r in R.occurrence_bonus(entities, spark.createDataFrame(chunks, "chunk_id string, content string")).collect()}
    assert {k: round(float(np.expm1(v))) for k, v in got.items()} == {("e1", "c1"): 2, ("e3", "c1"): 2, ("e2", "c1"): 1, ("e1", "c2"): 1, ("e3", "c2"): 1, ("e2", "c4"): 1}


def test_keyword_scores_with_small_tables(spark, monkeypatch):
    docs = [(f"d{i:03}", t) for i, t in enumerate(texts(2))]
    asked = [(1, "ab aa ab"), (2, "ba aba zz"), (3, "?"), (4, "漢字 bab")]
    df, q = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(asked, "query_id long, text string")
    want = {}
    for i, text in asked:
        terms = [t for t in re.findall("[a-zA-Z0-9_]+|[一-鿿]{2,}", text.lower()) if len(t) > 1]
        scores = sorted((-sum((t or "").lower().count(x) for x in terms), d) for d, t in docs)
        want |= {(i, k + 1): (d, -s) for k, (s, d) in enumerate(scores[:7]) if s}
    for table in (1, 1 << 26):  # a table of the least size is emptied again and again
        monkeypatch.setattr(R._Substrings, "TABLE", table)
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in R.keyword_top_k(df, q, 7).collect()}
        assert got == want


def test_runs_beyond_the_table():
    s = R._Substrings([["ab"], ["b", "ab"]])
    s.start()
    s.table = s.table[:4]
    runs = [["ab", "ba", "b", "abab", "bb", "a"][i % 6] * (1 + i % 3) for i in range(50)]
    assert s.score(runs).tolist() == [sum(r.count("ab") for r in runs), sum(r.count("ab") + r.count("b") for r in runs)]


def topics(n):
    """Documents in the order of their topics, some null or without a word."""
    rng = random.Random(n)
    common = [f"c{i}" for i in range(20)]
    out = []
    for i in range(n):
        own = [f"t{i * 12 // n}x{j}" for j in range(30)]
        out.append((f"d{i:05}", " ".join(rng.choice(own if rng.random() < 0.6 else common) for _ in range(rng.randrange(5, 40)))))
    return out + [("null", None), ("empty", ""), ("marks", "... !!"), ("long", "t3x1 " * 20_000)]


def test_index_equals_search_and_skips_blocks(spark, tmp_path):
    docs = spark.createDataFrame(topics(1500), "id string, text string").coalesce(2)
    asked = [(i, f"t{i}x1 t{i}x2 t{i}x7 c3") for i in range(12)] + [(50, "c1 c2 c2"), (51, "nowhere"), (52, None), (53, "t3x1 nowhere")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    X.write(docs, f"{tmp_path}/index", block_docs=32, folders=5)
    index = X.read(spark, f"{tmp_path}/index")
    found, counts = X.search(index, q, 6, checkpoint=stored)
    rows = lambda df: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 8)) for r in df.collect()}
    assert rows(found) == rows(R.bm25_top_k(docs, q, 6)) and len(rows(found)) > 80
    held = {r["query_id"]: (r["blocks"], r["opened"]) for r in counts.collect()}
    assert all(opened <= blocks for blocks, opened in held.values()) and 51 not in held
    assert sum(held[i][1] for i in range(12)) < sum(held[i][0] for i in range(12)) / 2  # over half of the blocks stay closed
    reach = X.bounds(index, X.asked_tokens(index, q))
    scored = X.opened(index, X.asked_tokens(index, q), reach).collect()
    assert len(scored) > 1000  # every document of every block, and none above its block's bound
    where = {i: r["block"] for r in index.postings.select("block", "ids").collect() for i in r["ids"]}
    most = {(r["query_id"], r["block"]): r["bound"] for r in reach.collect()}
    assert all(r["score"] <= most[r["query_id"], where[r["id"]]] + 1e-9 for r in scored)


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "id string, text string")
    X.write(none, f"{tmp_path}/index")
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    found, counts = X.search(X.read(spark, f"{tmp_path}/index"), q, 3, checkpoint=stored)
    assert found.count() == counts.count() == 0


def test_maxima_are_read_alone(spark, tmp_path):
    X.write(spark.createDataFrame(topics(60), "id string, text string"), f"{tmp_path}/index", folders=4)
    index = X.read(spark, f"{tmp_path}/index")
    plan = X.bounds(index, X.asked_tokens(index, spark.createDataFrame([(1, "t3x1")], "query_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "ReadSchema" in line and "most" in line)
    assert "ids" not in scan.split("ReadSchema")[1]


def test_sentences_meet_their_own_names(spark):
    chunks = spark.createDataFrame([("c1", "Ann saw Bo. bo left! Nobody else."), ("c2", "Ann."), ("c3", None)], "chunk_id string, content string")
    mentions = spark.createDataFrame([("c1", "ann", "Ann"), ("c1", "bo", "Bo"), ("c2", "bo", "Bo"), ("c3", "bo", "Bo")], "chunk_id string, key string, name string")
    got = {(r["chunk_id"], r["key"], r["sentence_no"]) for r in M.sentence_bridges(mentions, chunks).collect()}
    assert got == {("c1", "ann", 0), ("c1", "bo", 0), ("c1", "bo", 1), ("c1", "bo", 2)}


def test_cosine_join_skips_blocks_that_cannot_reach(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([c + rng.normal(size=(60, 24)) * 0.25 for c in centres] + [np.repeat(centres[:1], 300, axis=0)])  # one hot vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, [0.0] * 24), (5001, None), (5002, [None] * 24), (5003, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    for cap, block in ((100, 50), (1000, 128)):
        got = R.similar_pairs(df, 0.8, cap, checkpoint=stored, block=block, pivots=20).toPandas()
        for q in range(0, len(x), 37):
            want = [i for i in np.lexsort((np.arange(len(x)), -np.round(score[q], 9))) if i != q and round(score[q, i], 12) >= 0.8][:cap]
            mine = got[got["query_id"] == q]
            assert len(mine) == len(want) and np.allclose(np.sort(mine["score"]), np.sort(score[q, want]))
            if len(want) < cap:
                assert set(mine["id"]) == set(want)
    packs, pivots = R.pivot_blocks(df, checkpoint=stored, block=50, pivots=20)
    n = packs.count()
    assert R.reachable_blocks(packs, pivots, 0.8).count() < n * (n + 1) / 4  # over half of all pairs of blocks are never formed
    assert R.similar_pairs(df.limit(0), 0.8, 5, checkpoint=stored).count() == 0
