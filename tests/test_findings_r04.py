"""Steps of round 4's findings, against plain restatements of the whole job."""

import random

import numpy as np
import pandas as pd

import __spark_entry__
from corpusloom.operators import blockmax as X
from corpusloom.operators import cues as C
from corpusloom.operators import push as U
from corpusloom.operators import retrieval as R
from corpusloom.operators import steiner as ST
from corpusloom.plans.tables import stored


def test_personalized_pagerank_goes_on_to_the_ranks(spark, tmp_path):
    texts = {1: "\n".join(f"line {i}" for i in range(60)), 2: "Ann met Bo\nCy saw Ann\nx\ny\nBo and Dee", 3: "alone"}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(f"{tmp_path}/documents.parquet")
    got = {r["node_id"]: r["x"] for r in __spark_entry__.queries()["personalized_pagerank"](spark, str(tmp_path)).collect()}
    chain = [f"chunk:1_c{i:05d}" for i in range(15)]
    assert all(got[n] > 0 for n in chain)  # more than five edges from the only seed of their document
    # the first document hangs together by its chain alone, so its ranks are those of the chain
    step = np.zeros((15, 15))
    for i in range(14):
        step[i, i + 1] = step[i + 1, i] = 1.0
    step /= step.sum(axis=1, keepdims=True)
    want = np.linalg.solve(np.eye(15) - 0.85 * step.T, 0.15 * np.eye(15)[0])
    mine = np.array([got[n] for n in chain])
    assert np.allclose(mine / mine.sum(), want / want.sum(), atol=1e-10) and abs(sum(got.values()) - 1) < 1e-9


def test_suggestions_of_a_packed_graph_are_those_by_rows(spark):
    rng = random.Random(4)
    kinds = [("entity", f"e{i:02}") for i in range(30)] + [("chunk", f"c{i}") for i in range(12)] + [("summary", f"s{i}") for i in range(3)]
    edges = [(f"e{rng.randrange(29):02}", f"e{rng.randrange(29):02}", "semantic", float(rng.randrange(4))) for _ in range(60)]
    edges += [(f"e{rng.randrange(29):02}", f"c{i}", "source", 1.0) for i in range(12)] + [(f"s{i // 4}", f"c{i}", "structure", 1.0) for i in range(12)]
    nodes = stored(spark.createDataFrame(kinds, "node_type string, node_id string").repartition(3))
    table = spark.createDataFrame(edges, "source string, target string, edge_type string, weight double")
    seeds = spark.createDataFrame([(q, n) for q, n in ((1, "c3"), (1, "s0"), (2, "e05"), (3, "e29"), (4, "c7"), (4, "e01"))], "query_id long, node_id string")
    kept = ["scene", "query_id", "id", "rank"]
    packed, rows = (U.suggest(nodes, table, seeds, seeds.where("query_id <> 4"), 5, checkpoint=stored, packed=n) for n in (U.MOST_PACKED, 0))
    got, want = ({tuple(r[c] for c in kept): r["score"] for r in df.collect()} for df in (packed, rows))
    assert set(got) == set(want) and len(got) > 20 and max(abs(got[i] - want[i]) for i in got) < 1e-9
    # rounds are no jobs: what is stored does not grow with them
    held = []
    for tolerance in (1e-3, 1e-8):
        calls = []
        U.suggest(nodes, table, seeds, seeds, 5, checkpoint=lambda df, calls=calls: calls.append(1) or stored(df), tolerance=tolerance)
        held.append(len(calls))
    assert held[0] == held[1]


def test_blocks_give_only_what_can_be_among_the_best(spark, tmp_path):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(400)], "id int, text string").coalesce(1)
    X.write(docs, f"{tmp_path}/index", block_docs=64, folders=2)
    index = X.read(spark, f"{tmp_path}/index")
    asked = stored(X.asked_tokens(index, spark.createDataFrame([(1, "a b"), (2, "c"), (3, "zz"), (4, "a h h")], "query_id long, text string")))
    blocks = stored(X.bounds(index, asked).where("query_id <> 2 or block > 2").selectExpr("query_id", "block", "cast(null as double) least"))
    every = {(r["query_id"], r["id"]): r["score"] for r in X.opened(index, asked, blocks).collect()}
    best = lambda b: {(r["query_id"], r["id"]): r["score"] for r in X.best_of_blocks(index, asked, b, 3).collect()}
    got, few = best(blocks), best(blocks.selectExpr("query_id", "block", "1.5D least"))
    assert all(abs(every[i] - x) < 1e-12 for i, x in got.items()) and len(got) < len(every) / 3
    for q in (1, 2, 4):  # no row of the best is missing, and nothing below what is known to be reached comes
        third = sorted((x for (p, _), x in every.items() if p == q), reverse=True)[2]
        assert {i for i, x in every.items() if i[0] == q and x >= third} <= set(got)
    assert set(few) == {i for i, x in got.items() if x >= 1.5}


def test_trees_streamed_by_query_are_those_by_joins(spark):
    rng = random.Random(8)
    edges, ends, ranks = [], [], []
    for q in range(12):
        for _ in range(4 * q):
            a, b = rng.sample(range(10 + q), 2)
            c = rng.choice([0.1, 0.2, 0.2, 0.5, 1e-9])
            edges += [(q, f"n{a}", f"n{b}", c), (q, f"n{b}", f"n{a}", c)]
        ends += [(q, f"n{rng.randrange(14 + q)}") for _ in range(q % 5)] + [(q, None)]
        ranks += [(q, f"n{i}", rng.choice([0.0, 0.5, 0.5, 0.9, None])) for i in range(10 + q)]
    edges, ends = spark.createDataFrame(edges, "query_id int, a string, b string, cost double"), spark.createDataFrame(ends, "query_id int, node_id string")
    ranks = spark.createDataFrame(ranks, "query_id int, node_id string, x double")
    calls = []
    held = lambda df: calls.append(1) or stored(df)
    got = sorted(ST.connect(ends, edges, ranks, grow=3, checkpoint=held).collect())
    assert len(calls) <= 3  # no round of joins is stored
    for most in (0, 60):  # of these, all by joins, some
        assert sorted(ST.connect(ends, edges, ranks, grow=3, checkpoint=stored, most=most).collect()) == got
    assert len(got) > 40


def test_occurrence_bonus_moves_no_row_it_finds(spark):
    chunks = spark.createDataFrame([("c1", "Ann met ann"), ("c2", "annex"), ("c3", None)], "chunk_id string, content string")
    entities = spark.createDataFrame([("e1", "Ann"), ("e3", "ann"), (None, "met"), ("e4", None), ("e5", "")], "entity_id string, name string")
    found = R.occurrence_bonus(entities, chunks)
    assert {(r["entity_id"], r["chunk_id"]) for r in found.collect()} == {("e1", "c1"), ("e3", "c1"), ("e1", "c2"), ("e3", "c2"), (None, "c1")} and found.count() == 5
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_shared_are_counted_in_groups_without_wedges(spark):
    rng = random.Random(10)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(260)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rows = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in sorted(pairs)] + [("n00", "n00")], "source string, target string")
    want = {f"n{a:02}->n{b:02}": len((near[a] | near[b]) - {a, b}) for a, b in pairs} | {"n00->n00": len(near[0])}
    for edges in (1 << 21, 25, 1):
        made = []
        held = lambda df, made=made: made.append(df.count()) or stored(df)
        assert {r["object_id"]: r["n"] for r in C.relation_neighbour_counts(rows, checkpoint=held, group_edges=edges).collect()} == want
    assert C.relation_neighbour_counts(rows.limit(0), checkpoint=stored).count() == 0
    plan = C.relation_neighbour_counts(rows, checkpoint=stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("u#" in x and " < " in x for x in plan.split("\n") if "Join Inner" in x)
