"""Steps of round 3's findings, third pass, against the plainer steps they replace."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import cues as C
from corpusloom.operators import graphs as G
from corpusloom.operators import memory as M
from corpusloom.operators import paths as P
from corpusloom.plans.tables import stored


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _named(spark, n=40):
    rng = random.Random(3)
    some = [f"N{i}" for i in range(12)] + ["n1", "n2"]
    rows = [(f"{d}_c{i:05d}", d, f"doc_{d}.txt", i, 4 * i + 1, 4 * i + 4, rng.sample(some, rng.randrange(8))) for d in range(n // 5) for i in range(5)]
    return stored(spark.createDataFrame(rows, "chunk_id string, doc_id long, file_name string, chunk_index int, start_line int, end_line int, names array<string>"))


def test_scenes_of_a_batch_are_ranked_as_scenes_alone(spark):
    rng = random.Random(8)
    nodes = [(q, f"n{i}", float(i == 0)) for q in range(30) for i in range(2 + q % 7)] + [(99, "alone", 1.0)]
    pairs = {(q, *sorted(rng.sample([n for p, n, _ in nodes if p == q], 2))) for q in range(30) for _ in range(q % 5)}
    edges = spark.createDataFrame([(*e, 0.5 + rng.random()) for e in sorted(pairs)] + [(50, "no", "node", 1.0), (3, "n0", "elsewhere", 9.0)], "query_id long, a string, b string, w double")
    restart = spark.createDataFrame(nodes, "query_id long, node_id string, r double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # scenes go on in the next batch
    try:
        got = P.pagerank_grouped(edges, restart, rounds=7, tolerance=0.0)
        assert "CoGroup" not in _plan(got)  # a group per scene is a call per document
        ranks = {(r["query_id"], r["node_id"]): r["x"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = [(q, a, b, w) for q, a, b, w in map(tuple, edges.collect()) if {(q, a), (q, b)} <= set(ranks)]
    assert len(ranks) == len(nodes)
    for q in {q for q, _, _ in nodes}:
        own = {n: r for p, n, r in nodes if p == q}
        x = dict.fromkeys(own, 1 / len(own))
        out = {n: sum(w for p, a, b, w in known if p == q and n in (a, b)) for n in own}
        for _ in range(7):
            lost = sum(x[n] for n in own if not out[n])
            new = {n: 0.15 * own[n] + 0.85 * lost * own[n] for n in own}
            for p, a, b, w in known:
                if p == q:
                    new[b] += 0.85 * x[a] * w / out[a]
                    new[a] += 0.85 * x[b] * w / out[b]
            x = new
        assert all(abs(ranks[q, n] - v) < 1e-12 for n, v in x.items())


def test_source_edges_and_keys_of_chunks_need_no_shuffle(spark):
    n = _named(spark)
    for got, want in (
        (G.chunk_source_edges(n), G.source_edges(G.mentions(n), G.co_occurrences(n))),
        (M.chunk_keys(n).select("chunk_id", "key"), M.entity_mentions(n, G.co_occurrences(n)).select("chunk_id", "key")),
    ):
        assert "Exchange" not in _plan(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entity_cues_hold_no_list_of_all_places(spark):
    n = _named(spark)
    relations = G.merge_relations(G.co_occurrences(n))
    got = C.entity_cues(G.entity_names(G.mentions(n)), relations, G.chunk_places(n))
    want = C.entity_cues(G.merge_entities(G.mentions(n)), relations)
    assert "collect_set(locate" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bridges_of_chunks_need_no_shuffle(spark):
    n = _named(spark).withColumn("content", F.concat(F.array_join("names", " goes where the other one is. "), F.lit(" ends the chunk here and now.")))
    got = M.chunk_bridges(n, least=10)
    want = M.sentence_bridges(M.entity_mentions(n, G.co_occurrences(n)), n, least=10)
    assert "Exchange" not in _plan(got)
    assert got.count() and sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
