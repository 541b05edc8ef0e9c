"""Operators in rounds of joins against plain restatements: push, claims, trees, global ranks."""

import itertools
import os
import random

import numpy as np
import pytest

from corpusloom.operators import cues as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import memory as M
from corpusloom.operators import push as U
from corpusloom.operators import ranks as N
from corpusloom.operators import search as S
from corpusloom.operators import steiner as ST
from corpusloom.plans.tables import stored

DATA = "/root/testdata/sf0.001"


def ranks_by_power(nodes, weights, seeds, damping=0.85):
    """weights: {(a, b): w} both ways, inside nodes."""
    at = {n: i for i, n in enumerate(nodes)}
    p, r = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for (a, b), w in weights.items():
        p[at[a], at[b]] = w
    out = p.sum(axis=1)
    p[out > 0] /= out[out > 0, None]
    r[[at[s] for s in seeds]] = 1 / len(seeds)
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(400):
        x = (1 - damping) * r + damping * (x @ p + x[out == 0].sum() * r)
    return dict(zip(nodes, x, strict=True))


def test_push_equals_power_iteration_in_both_scenes(spark):
    rng = random.Random(5)
    kinds = [("entity", f"e{i}") for i in range(40)] + [("chunk", f"c{i}") for i in range(25)] + [("summary", f"s{i}") for i in range(8)]
    nodes = spark.createDataFrame([(i, k) for k, i in kinds], "node_id string, node_type string")
    edges = [(f"e{rng.randrange(40)}", f"e{rng.randrange(38)}", "semantic", rng.choice([0.5, 1.0, 3.0])) for _ in range(70)]
    edges += [(f"e{rng.randrange(38)}", f"c{i}", "source", 1.0) for i in range(24) for _ in range(2)]  # c24 and two entities stay alone
    edges += [("e0", f"e{i}", "semantic", 1.0) for i in range(1, 30)]  # a hub
    edges += [(f"s{i // 5}", f"c{i}", "structure", 1.0) for i in range(24)] + [("s5", f"s{i}", "structure", 1.0) for i in range(5)] + [("e1", "nowhere", "semantic", 9.0)]
    edges += edges[:5]
    table = spark.createDataFrame(edges, "source string, target string, edge_type string, weight double")
    text = {1: ["c3", "c7", "e5"], 2: ["s5"], 3: ["s1", "c24"], 4: ["c24"]}
    graph = {1: ["e0"], 2: ["e3", "c2"], 3: ["e39"]}
    rows = lambda d: spark.createDataFrame([(q, n) for q, v in d.items() for n in v], "query_id long, node_id string")
    got = U.suggest(nodes, table, rows(text), rows(graph), 100, checkpoint=stored).collect()
    weights = {}
    for a, b, kind, w in edges:
        if a != b:
            for x in ((a, b), (b, a)):
                weights[x] = max(weights.get(x, 0), max(w, 1.0) if kind == "semantic" else 1.0)
    below = {"s5": {f"s{i}" for i in range(5)}}
    parents = {f"c{i}": {f"s{i // 5}", "s5"} for i in range(24)} | {f"s{i}": {"s5"} for i in range(5)}
    for scene, asked in (("text", text), ("graph", graph)):
        for q, seeds in asked.items():
            scope = [i for k, i in kinds if k != "summary"]
            if scene == "text":
                scope += sorted(set().union(*[parents.get(s, set()) | ({s} | below.get(s, set()) if s[0] == "s" else set()) for s in seeds]))
            inside = {k: w for k, w in weights.items() if k[0] in scope and k[1] in scope}
            want = ranks_by_power(scope, inside, seeds)
            found = {r["id"]: r for r in got if (r["scene"], r["query_id"]) == (scene, q)}
            assert all(r["error"] < 1e-8 for r in found.values())
            assert sum(abs(found[i]["score"] - want[i]) for i in found) < 1e-8
            assert not any(i in seeds or i[0] != "e" for i in found)
            assert all(want[i] < 1e-9 for k, i in kinds if k == "entity" and i not in found and i not in seeds)


def test_push_touches_only_what_is_near(spark):
    """A bound above what arrives far away leaves a long chain untouched, and the error says what is missing."""
    chain = [(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(200)]
    adj = spark.createDataFrame(chain + [(b, a, w) for a, b, w in chain], "a string, b string, w double")
    restart = spark.createDataFrame([(1, "n000", 1.0)], "query_id long, node_id string, r double")
    near = U.forward_push(adj, restart, checkpoint=stored, bound=1e-2, most=12).collect()
    exact = {r["node_id"]: r["x"] for r in U.forward_push(adj, restart, checkpoint=stored, tolerance=1e-4).collect()}
    assert len(near) < 14 < len(exact) < 40 and near[0]["error"] > 1e-3
    assert sum(abs(r["x"] - exact[r["node_id"]]) for r in near) < 2 * near[0]["error"]


@pytest.mark.parametrize("seed", range(3))
def test_claims_as_if_the_strongest_chose_first(spark, seed):
    rng = random.Random(seed)
    rows = [(q, f"k{k}", [0.9, 0.5, 0.5, 0.7, 0.2, 0.9][k % 6], f"s{s:02}", rng.choice([0.1, 0.4, 0.4, 0.8])) for q in range(3) for k in range(9) for s in range(14) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "query_id long, key string, strength double, sentence_id string, score double")
    got = {(r["query_id"], r["key"], r["sentence_id"]) for r in M.claims(df, 2, checkpoint=stored).collect()}
    want = set()
    for q in range(3):
        used = set()
        for _, key in sorted({(-r[2], r[1]) for r in rows if r[0] == q}):
            for _, s in sorted((-r[4], r[3]) for r in rows if r[0] == q and r[1] == key and r[3] not in used)[:2]:
                used.add(s)
                want.add((q, key, s))
    assert got == want
    assert M.claims(df.limit(0), 2, checkpoint=stored).count() == 0


def cheapest_tree(nodes, edges, terminals):
    """By all subsets of further nodes: the least cost of a spanning tree that holds the terminals."""
    best = float("inf")
    rest = [n for n in nodes if n not in terminals]
    for k in range(len(rest) + 1):
        for more in itertools.combinations(rest, k):
            inside = {*terminals, *more}
            parent, cost, parts = {n: n for n in inside}, 0.0, len(inside)

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for c, a, b in sorted((c, a, b) for (a, b), c in edges.items() if a in inside and b in inside):
                if find(a) != find(b):
                    parent[find(a)], cost, parts = find(b), cost + c, parts - 1
            if parts == 1:
                best = min(best, cost)
    return best


def test_trees_cost_at_most_twice_the_cheapest(spark):
    rng = random.Random(4)
    nodes, graphs = [f"n{i}" for i in range(9)], {}
    for q in range(8):
        edges = {}
        for a, b in itertools.combinations(nodes, 2):
            if rng.random() < 0.4:
                edges[a, b] = rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])
        graphs[q] = edges, rng.sample(nodes, 4)
    rows = [(q, *x, c) for q, (edges, _) in graphs.items() for e, c in edges.items() for x in (e, e[::-1])]
    table = spark.createDataFrame(rows, "query_id long, a string, b string, cost double")
    ends = spark.createDataFrame([(q, t) for q, (_, ts) in graphs.items() for t in ts], "query_id long, node_id string")
    got = {}
    for r in ST.tree(ends, table, checkpoint=stored).collect():
        got.setdefault(r["query_id"], set()).add(r["node_id"])
    checked = 0
    for q, (edges, ts) in graphs.items():
        linked = {n for e in edges for n in e}
        least = cheapest_tree(sorted(linked), edges, set(ts) & linked)
        assert set(ts) & linked <= got[q]
        if least < float("inf"):
            assert cheapest_tree(sorted(got[q]), edges, got[q]) <= 2 * least + 1e-9
            checked += 1
    assert checked >= 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_tables_of_activation_and_trees(spark):
    """The registered queries against restatements over all documents of the smallest tables."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    from pyspark.sql import functions as F

    from corpusloom import queries_memory as Q
    from corpusloom.plans import base as B

    n = stored(B.named(spark, DATA))
    seeds = {}
    for r in Q._anchors(n).select("query_id", F.col("node_id").alias("key"), (1.0 / (1 + F.col("pos"))).alias("score")).distinct().collect():
        seeds.setdefault(r["query_id"], {}).setdefault(r["key"], []).append(r["score"])
    bridges = M.sentence_bridges(Q._mentions(n), n, least=20).join(n.select("chunk_id", "doc_id"), "chunk_id")
    rows = {}
    for r in bridges.select("doc_id", "key", F.concat_ws(":", "chunk_id", F.col("sentence_no").cast("string")).alias("s"), F.abs(F.cos(F.length("sentence").cast("double"))).alias("v")).collect():
        rows.setdefault(r["doc_id"], {}).setdefault(r["s"], [r["v"], set()])[1].add(r["key"])
    want = {}
    for q, given in seeds.items():
        best = {k: max(v) for k, v in given.items()}
        now = dict(best)
        for _ in range(2):
            used, then = set(), {}
            for _, key in sorted((-v, k) for k, v in now.items() if v >= 0.5):
                open_ = sorted((-v, s) for s, (v, keys) in rows.get(q, {}).items() if key in keys and s not in used)[:3]
                for v, s in open_:
                    used.add(s)
                    if now[key] * -v >= 0.5:
                        for other in rows[q][s][1]:
                            then[other] = max(then.get(other, 0), now[key] * -v)
            now = then
            for k, v in then.items():
                best[k] = max(best.get(k, 0), v)
        want |= {(q, k): round(v, 6) for k, v in best.items()}
    got = {(r["query_id"], r["key"]): round(r["score"], 6) for r in queries["activated_entities"](spark, DATA).collect()}
    assert got == want and len(got) > 400
    found = {}
    for r in queries["connected_terminals"](spark, DATA).collect():
        found.setdefault(r["query_id"], set()).add(r["node_id"])
    ends, links = {}, {}
    for r in Q._anchors(n).collect():
        ends.setdefault(r["query_id"], set()).add(r["node_id"])
    for r in Q._neighbourhood(n).collect():
        links.setdefault(r["query_id"], {}).setdefault(r["a"], set()).add(r["b"])

    def part(q, start, inside=None):
        seen, todo = {start}, [start]
        while todo:
            for m in links[q].get(todo.pop(), ()):
                if m not in seen and (inside is None or m in inside):
                    seen.add(m)
                    todo.append(m)
        return seen

    for q, ts in ends.items():
        ts = {t for t in ts if t in links.get(q, {})}
        assert ts <= found.get(q, set())
        for a, b in itertools.combinations(sorted(ts), 2):  # joined inside the tree wherever a path exists at all
            assert (b in part(q, a)) == (b in part(q, a, found[q]))


def test_global_ranks_and_subsets(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) if i % 9 else None, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "v int, t string")
    got = N.global_ranks(df, ["v", "t"], checkpoint=stored, part_rows=37).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["v"], r["t"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(500))
    same = spark.createDataFrame([(1,)] * 100, "v int")  # one key holds every row
    assert sorted(r["place"] for r in N.global_ranks(same, ["v"], checkpoint=stored, part_rows=9).collect()) == list(range(100))
    assert N.global_ranks(df.limit(0), ["v"], checkpoint=stored).count() == 0
    docs = spark.createDataFrame([(i // 2,) for i in range(40)], "doc_id long")
    assert sorted({r["doc_id"] for r in S.first_fraction(docs, 0.21, checkpoint=stored).collect()}) == [0, 1, 2, 3, 4]
    text = spark.createDataFrame([(i, "x" * (i * 7 % 11)) for i in range(11)], "pos long, text string")
    for size in range(2, 11):
        places = sorted(r["place"] for r in S.by_length(text, size, checkpoint=stored).collect())
        assert places == [round(i * 10 / (size - 1)) for i in range(size)]


def test_no_plan_deals_all_rows_to_one_task(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    plan = N.global_ranks(df, ["doc_id"], checkpoint=stored, part_rows=10)._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(single) <= 1 and "_tie" not in "".join(single)  # the window over one row per range


def test_bootstrap_intervals_within_simulation_error(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.random(20_000).round(2), "scores": rng.normal(3, 2, 400), "few": np.array([0.0, 1.0, 1.0, 0.5, 2.0] * 8), None: rng.integers(0, 2, 300).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    got = {r["g"]: r for r in E.bootstrap(df, "g", n_boot=2000).collect()}
    for k, v in groups.items():
        means = np.sort([rng.choice(v, len(v)).mean() for _ in range(2000)])
        spread = v.std() / len(v) ** 0.5
        r = got[k]
        assert (r["n"], r["mean"]) == (len(v), pytest.approx(v.mean()))
        assert abs(r["low"] - means[49]) < 0.3 * spread and abs(r["high"] - means[1949]) < 0.3 * spread
    again = {r["g"]: r for r in E.bootstrap(df.repartition(3), "g", n_boot=2000).collect()}
    assert all(again[k]["low"] == pytest.approx(got[k]["low"], abs=1e-12) for k in groups)
    assert E.bootstrap(df.limit(0), "g").count() == 0
    pairs = [("a", float(x), float(y)) for x, y in zip(rng.normal(0, 1, 500), rng.normal(0, 1, 500), strict=True)] + [("b", float(x) + 1, float(x) + rng.normal(0, 0.1)) for x in rng.normal(0, 1, 200)]
    r = {r["g"]: r for r in E.paired_bootstrap(spark.createDataFrame(pairs + [("c", None, 1.0)], "g string, a double, b double"), "g", n_boot=1000).collect()}
    assert r["a"]["p"] > 0.01 and r["a"]["low"] < 0 < r["a"]["high"] + 0.1 and r["b"]["p"] == 0 and 0.95 < r["b"]["low"] < r["b"]["high"] < 1.05
    assert (r["c"]["n"], r["c"]["diff"], r["c"]["p"]) == (0, 0, 1)


def test_greedy_cues_as_if_every_gain_were_worked_out_each_time(spark):
    rng = random.Random(6)
    rows = [(f"o{i % 3}", "semantic", f"c{i:03}", rng.choice([0.1, 0.5]), rng.choice([0.25, 0.5, 1.0]), [f"u{rng.randrange(25)}" for _ in range(rng.randrange(6))]) for i in range(150)]
    schema = "object_id string, family string, cue_id string, score double, weight double, units array<string>"
    got = {}
    for r in C.select_greedy(spark.createDataFrame(rows, schema), 12).collect():
        got.setdefault(r["object_id"], {})[r["pick"]] = (r["cue_id"], r["gain"])
    for o in ("o0", "o1", "o2"):
        rest, covered, want = [r for r in rows if r[0] == o], {}, []
        while rest and len(want) < 12:
            gain = lambda r: sum(max(0.0, r[4] - covered.get(u, 0.0)) for u in r[5])  # noqa: E731, B023
            best = min(rest, key=lambda r: (-gain(r), -r[3], r[2]))
            if gain(best) <= 0:
                break
            want.append((best[2], gain(best)))
            rest.remove(best)
            for u in best[5]:
                covered[u] = max(covered.get(u, 0.0), best[4])
        assert [got[o][i] for i in range(len(got[o]))] == want
    many = spark.range(100_000).selectExpr("'hot' object_id", "'f' family", "concat('c', id) cue_id", "id % 7 / 7.0 score", "1.0D weight", "array(id % 900, id % 1300) units")
    assert C.select_greedy(many, 50).agg({"gain": "sum"}).first()[0] == 100  # two new units each
    assert C.select_greedy(many.limit(0), 5).count() == 0
