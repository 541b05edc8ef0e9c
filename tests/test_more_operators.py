"""Grouped maps, blocked searches and model tables against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import documents as D
from corpusloom.operators import memory as M
from corpusloom.operators import models as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import search as S
from corpusloom.operators import steiner as ST
from corpusloom.plans.tables import stored
from corpusloom.sources import files as SF


def test_packed_ranges_cover_and_fit():
    rng = random.Random(1)
    for _ in range(300):
        costs = [rng.randrange(1, 12) for _ in range(rng.randrange(20))]
        budget, overlap = rng.randrange(1, 20), rng.randrange(6)
        seen = []
        for a, b in D.packed(costs, budget, overlap):
            assert costs[a] > budget if b is None else sum(costs[a:b]) <= budget + overlap
            seen += [a] if b is None else list(range(a, b))
        assert sorted(set(seen)) == list(range(len(costs)))
        assert [i for a, b in D.packed(costs, budget) for i in ([a] if b is None else range(a, b))] == list(range(len(costs)))


def frames(spark, rng, n=60, m=9):
    words = ["ab", "abc", "b", "cab", "xy_1", "漢字", "bb"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randrange(k)))
    docs = [(f"d{i:03}", text(20)) for i in range(n)] + [("none", None), ("empty", "")]
    asked = [(i, text(6)) for i in range(m)] + [(100, None), (101, "")]
    return spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize("block", [3, 512])
def test_blocked_searches_equal_all_scores(spark, block):
    rng = random.Random(block)
    docs, asked = frames(spark, rng)
    for found, every in (
        (R.keyword_top_k(docs, asked, 4, block=block), R.keyword_scores(docs, asked)),
        (R.bm25_top_k(docs, asked, 4, block=block), R.bm25(R.postings(docs), asked)),
    ):
        want = R.top_k(every, 4, order=[F.desc(F.round("score", 9)), "id"])
        key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
        assert key(found) == key(want)
    assert R.bm25_top_k(docs.limit(0), asked, 4).count() == 0 and R.keyword_top_k(docs, asked.limit(0), 4).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_dense_search_and_pairs_against_numpy(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 6)).round(2)
    x[10:14] = x[9]
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.round(unit @ unit.T, 9)
    found = {(r["query_id"], r["rank"]): r["id"] for r in R.dense_top_k(v, v.where("id < 11").withColumnRenamed("id", "query_id"), 5, block=block).collect()}
    for q in range(11):
        order = np.lexsort((np.arange(70), -s[q]))[:5]
        assert [found[q, k + 1] for k in range(5)] == order.tolist()
    pairs = {(r["query_id"], r["id"]) for r in R.similar_pairs(v, 0.5, 100, checkpoint=stored, block=block * 4, pivots=5).collect()}
    assert pairs == {(i, j) for i, j in itertools.permutations(range(70), 2) if round(unit[i] @ unit[j], 12) >= 0.5}


def test_first_ranges(spark):
    rows = [(1, i, f, a, b) for i, (f, a, b) in enumerate([("x", 1, 3), ("x", 4, 6), ("x", 5, 9), ("y", 4, 4), ("x", 8, 9), ("x", 11, 12), ("x", 10, 10)])]
    df = spark.createDataFrame(rows, "query_id long, pos long, file_name string, start_line long, end_line long")
    assert sorted(r["pos"] for r in S.first_ranges(df).collect()) == [0, 2, 3, 5]
    assert S.first_ranges(df.limit(0)).count() == 0


def test_activation(spark):
    seeds = spark.createDataFrame([(1, "a", 1.0), (1, "z", 0.4), (2, "q", 0.9)], "query_id long, key string, score double")
    near = [(1, "a", "s1", 0.9), (1, "b", "s1", 0.9), (1, "b", "s2", 0.7), (1, "c", "s2", 0.7), (1, "z", "s3", 1.0), (1, "y", "s3", 1.0), (1, "a", "s4", 0.3), (1, "d", "s4", 0.3)]
    sentences = spark.createDataFrame(near, "query_id long, key string, sentence_id string, score double")
    got = {(r["query_id"], r["key"]): round(r["score"], 6) for r in M.activate(seeds, sentences, checkpoint=stored).collect()}
    # b by the best sentence of a; c from b in the second round; z is too weak to fire, s4 too far
    assert got == {(1, "a"): 1.0, (1, "b"): 0.9, (1, "c"): 0.63, (1, "z"): 0.4, (2, "q"): 0.9}


def test_connected_terminals(spark):
    edges = [("a", "m", 0.1), ("m", "b", 0.1), ("a", "b", 0.5), ("b", "c", 0.2), ("x", "y", 0.1), ("m", "n", 0.1), ("c", "k", 0.4)]
    both = [(1, a, b, c) for a, b, c in edges] + [(1, b, a, c) for a, b, c in edges]
    terminals = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "x", 2), (1, "gone", 3)], "query_id long, node_id string, pos int")
    ranks = spark.createDataFrame([(1, "k", 9.0), (1, "c", 1.0), (1, "n", 0.0)], "query_id long, node_id string, x double")
    cost = spark.createDataFrame(both, "query_id long, a string, b string, cost double")
    nodes = lambda grow: sorted(r["node_id"] for r in ST.connect(terminals, cost, ranks, grow=grow, checkpoint=stored).collect())
    assert nodes(0) == ["a", "b", "m", "x"]
    assert nodes(1) == ["a", "b", "c", "m", "x"]
    assert nodes(9) == ["a", "b", "c", "k", "m", "x"]


def flaky():
    seen = {}

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        for p in prompts:
            seen[p] = seen.get(p, 0) + 1
        return [f"{p}!{seen[p]}" for p in prompts]

    return model


def test_answers_errors_and_cache(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "bad"), ("3", "x"), ("4", "y")], "id string, prompt string")
    got = {r["id"]: (r["answer"], r["error"]) for r in L.ask(rows.coalesce(1), flaky).collect()}
    assert got["2"] == (None, "ValueError: no") and got["4"][0].startswith("y!")
    cache = spark.createDataFrame([], "key string, answer string")
    answers, made = L.cached(rows, cache, "m", flaky)
    assert {r["id"]: r["answer"] for r in answers.collect()} == {"1": "x!1", "2": None, "3": "x!1", "4": "y!1"}
    assert made.count() == 2
    later, more = L.cached(rows, made, "m", flaky)
    assert more.count() == 0 and {r["id"]: r["answer"] for r in later.collect()}["3"] == "x!1"
    assert L.cached(rows, made, "other", flaky)[1].count() == 2


def agent():
    def say(p):
        if "fact" in p:
            return "<think>t</think><answer> got it </answer>"
        return "<answer>guess</answer>" if "eager" in p else "<search>find me</search>"

    return lambda prompts: [say(p) for p in prompts]


def test_agents_search_before_they_answer(spark):
    questions = spark.createDataFrame([(1, "eager one"), (2, "plain"), (3, "lost")], "question_id long, text string")
    asked = []

    def search(wanted):
        rows = [(r["question_id"], r["query"]) for r in wanted.collect()]
        asked.extend(rows)
        return spark.createDataFrame([(i, "fact " + q) for i, q in rows if i != "3"], "question_id string, chunk string")

    got = {r["question_id"]: (r["answer"], r["rounds"], r["n_evidence"]) for r in L.rounds(questions, search, agent, most=3, stored=stored)[0].collect()}
    assert got == {"1": ("got it", 2, 1), "2": ("got it", 2, 1), "3": (L.NO_EVIDENCE, 3, 0)}
    assert ("1", "eager one") in asked and ("2", "find me") in asked  # an early answer searches the question


def test_batches_keep_traces_and_go_on(spark, tmp_path):
    asked = []

    def search(wanted):
        rows = [(r["question_id"], r["query"]) for r in wanted.collect()]
        asked.extend(i for i, _ in rows)
        return spark.createDataFrame([(i, "fact " + q) for i, q in rows if i != "3"], "question_id string, chunk string")

    q = lambda *ids: spark.createDataFrame([(i, "eager" if i == 1 else "plain") for i in ids], "question_id long, text string")
    first = L.run_batch(q(1, 3), search, agent, f"{tmp_path}/b", stored=stored)
    assert {r["question_id"]: r["answer"] for r in first.collect()} == {"1": "got it", "3": L.NO_EVIDENCE}
    asked.clear()
    both = L.run_batch(q(1, 2, 3), search, agent, f"{tmp_path}/b", stored=stored)
    assert {r["question_id"]: r["answer"] for r in both.collect()} == {"1": "got it", "2": "got it", "3": L.NO_EVIDENCE} and set(asked) == {"2"}
    asked.clear()
    assert L.run_batch(q(1, 2, 3), search, agent, f"{tmp_path}/b", stored=stored).count() == 3 and not asked
    trace = {(r["question_id"], r["round"]): (r["said"], r["query"], r["n_evidence"]) for r in spark.read.parquet(f"{tmp_path}/b/traces").collect()}
    assert trace["1", 1] == ("<answer>guess</answer>", "eager", 0) and trace["1", 2] == ("<think>t</think><answer> got it </answer>", None, 1)
    assert trace["3", 3][1] is None and ("2", 2) in trace and len(trace) == 7
    assert L.run_batch(q(1).limit(0), search, agent, f"{tmp_path}/none", stored=stored).count() == 0


def test_whole_texts_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.md").write_text("# é\n\n")
    (tmp_path / "c.txt").write_text("")
    got = {r["file_name"]: r["text"] for r in SF.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and got["b.md"] == "# é\n\n"


def test_pairs_with_both_directions_resolve_to_one_edge(spark):
    nodes = spark.createDataFrame([("x", "chunk")], "node_id string, node_type string")
    edges = spark.createDataFrame([("b", "a", "e1"), ("a", "b", "e1"), ("a", "b", "e2")], "source string, target string, edge_id string")
    hits = spark.createDataFrame([(1, None, None, None, "b", "a", None), (2, None, "e1", None, None, None, None), (3, "x", None, None, None, None, None)], "k int, node_id string, id string, chunk_id string, source string, target string, edge_id string")
    got = sorted((r["k"], r["object_id"], r["object_type"]) for r in S.resolved(hits, nodes, edges).collect())
    assert got == [(1, "a->b", "relation"), (2, "a->b", "relation"), (3, "x", "chunk")]


def test_one_round_answers(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "closed")], "question_id long, text string")
    evidence = spark.createDataFrame([(1, "c2", 2, "two"), (1, "c1", 1, "one"), (1, "c9", 9, "late")], "query_id long, id string, rank int, content string")
    echo = lambda: lambda prompts: [f"<answer>{p}</answer>" for p in prompts]
    got = {r["question_id"]: r["answer"] for r in L.answered(questions, evidence, echo).collect()}
    assert got == {"1": "one\ntwo\nQuestion: q", "2": "Question: closed"}


def test_stage_timer(spark, tmp_path):
    path = f"{tmp_path}/log"
    with L.timed_stage(spark, path, "a", dataset="d"):
        pass
    with pytest.raises(RuntimeError), L.timed_stage(spark, path, "b"):
        raise RuntimeError
    rows = {r["stage"]: r for r in spark.read.json(path).collect()}
    assert rows["a"]["status"] == "ok" and rows["a"]["dataset"] == "d" and rows["b"]["status"] == "failed"


def test_length_sample_moves_on_where_a_place_is_taken(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(23)], "pos long, text string")
    for size in (0, 1, 2, 5, 22, 23, 40):
        got = S.by_length(rows, size, checkpoint=stored).count()
        assert got == min(size, 23)


def test_import_failures_inside_the_optional_folder_are_raised(monkeypatch):
    import __spark_entry__ as entry

    def absent(name):
        raise ModuleNotFoundError("x", name="numpy_not_here")

    monkeypatch.setattr(entry, "import_module", absent)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("corpusloom.llm.queries", "corpusloom.llm")
    monkeypatch.setattr(entry, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("x", name="corpusloom.llm")))
    assert entry._optional("corpusloom.llm.queries", "corpusloom.llm") is None
