"""Steps whose rows once grew with the square of the input, against restatements of what they return."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import cues as C
from corpusloom.operators import memory as M
from corpusloom.operators import retrieval as R
from corpusloom.plans.tables import stored


def test_neighbour_counts_are_those_of_the_cues(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(12)}") for _ in range(120)} | {("n1", "n1"), ("x", "y"), ("z", "z")}
    rows = spark.createDataFrame([(a, b, []) for a, b in sorted(pairs)] * 2, "source string, target string, source_locates array<string>")
    want = C.relation_cues(rows).where("family = 'semantic'").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(C.relation_neighbour_counts(rows, checkpoint=stored).collect()) == sorted(want.collect())


def test_chunks_of_nodes_by_sets_of_nodes(spark):
    rng = random.Random(7)
    links = {(f"k{min(rng.randrange(9), rng.randrange(9))}", f"c{rng.randrange(40):02d}") for _ in range(150)}
    nodes = {(q, f"k{rng.randrange(12)}") for q in range(25) for _ in range(rng.randrange(7))} | {(3, "chunk:c05"), (4, "chunk:none"), (99, "k0")}
    want = {}
    for q in {q for q, _ in nodes}:
        n = Counter(c for p, key in nodes if p == q for k, c in links if k == key)
        n.update(key[6:] for p, key in nodes if p == q and key.startswith("chunk:"))
        want[q] = sorted(((-s, c) for c, s in n.items()))[:3]
    nodes = spark.createDataFrame(sorted(nodes), "query_id long, node_id string")
    links = spark.createDataFrame(sorted(links), "key string, chunk_id string")
    for most in (8, 3, 0):  # of these, all by sets, some, none
        got = {}
        for r in M.chunks_of_nodes(nodes, links, 3, checkpoint=stored, most=most).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        assert got == {q: v for q, v in want.items() if v}, most


def test_reasoning_paths_look_edges_up_by_both_ends(spark):
    nodes = spark.createDataFrame([(q, n) for q in (1, 2) for n in ("a", "b", "c", "chunk:x")] + [(2, "d")], "query_id long, node_id string")
    edges = spark.createDataFrame([("a", "b", "l"), ("b", "d", "m"), ("a", "e", "n"), ("b", "c", "o")], "a string, b string, label string")
    ranks = spark.createDataFrame([(2, "b", 0.5), (2, "c", 0.1)], "query_id long, node_id string, x double")
    found = M.reasoning_paths(nodes, edges, ranks, 2)
    line = "({} [SEP] {} [SEP] {})".format
    assert {r["query_id"]: r["facts"] for r in found.collect()} == {1: line("a", "l", "b") + "\n" + line("b", "o", "c"), 2: line("b", "o", "c") + "\n" + line("b", "m", "d")}
    joins = [x for x in str(found._jdf.queryExecution().optimizedPlan().toString()).split("\n") if "Join Inner" in x]
    assert any(re.search(r"\(a#\d+ = a#\d+\) AND \(b#\d+ = b#\d+\)", x) for x in joins)


def test_keyword_scores_form_no_pair_that_scores_nothing(spark):
    texts = {1: "Ann saw ann's ananas", 2: None, 3: "nothing", 4: "bob_1 bob bobob 图结构图结构"}
    asked = {7: "ann an", 8: "bob bob", 9: "", 10: "图结构 zz", 11: None}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    found = R.keyword_scores(docs, queries, block=2)
    words = lambda q: re.findall(r"[a-z0-9_]+|[一-鿿]{2,}", (q or "").lower())
    want = {(q, i, sum((t or "").lower().count(w) for w in words(x) if len(w) >= 2)) for q, x in asked.items() for i, t in texts.items()}
    assert {tuple(r) for r in found.collect()} == {w for w in want if w[2]}
    assert found.schema.simpleString() == "struct<query_id:int,id:bigint,score:bigint>"
    assert "Join" not in str(found._jdf.queryExecution().optimizedPlan().toString())
