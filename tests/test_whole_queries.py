"""Queries without SQL, run from tables, against brute force."""

import hashlib
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import queries as Q
from corpusloom.operators import evaluation as E
from corpusloom.plans import base as B

TEXTS = [
    "\n".join(f"Ann Lee saw Bob at step {i}" if i % 9 == 0 else f"plain words {i}" for i in range(1, 41)),
    "Bob met Cy\nnothing more",
    "no names here at all",
    "Dora wrote\n\n" + "\n".join(f"line {i}" for i in range(30)) + "\nto Cy",
    "Zoe alone",
]


def tables(spark, at, texts, **more):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{at}/documents.parquet")
    for name, df in more.items():
        df.write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("tables") / "t", TEXTS)


def graph(spark, d):
    nodes, edges = Q._graph(spark, d, B.whole_named)
    return [r["node_id"] for r in nodes.collect()], [tuple(r) for r in edges.select("source", "target", "edge_type", "weight").collect()]


def test_components_of_the_whole_graph(spark, corpus):
    nodes, edges = graph(spark, corpus)
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b, *_ in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node_id"]: r["component"] for r in Q.queries()["graph_components"](spark, corpus).collect()}
    assert got == {n: root(n) for n in nodes}
    assert got["chunk:2_c00000"] == "chunk:2_c00000"  # no edge at all
    assert got["chunk:0_c00009"] == got["chunk:1_c00000"] == got["chunk:3_c00000"] and len(set(got.values())) == 3


def test_pagerank_until_it_converges(spark, tmp_path):
    d = tables(spark, tmp_path / "t", ["\n".join(["Ann saw Bob"] + [f"plain {i}" for i in range(30)]), "Bob", "none"])
    nodes, edges = graph(spark, d)
    w = {}
    for a, b, kind, x in edges:
        x = max(x, 1.0) if kind == "semantic" else 1.0
        w[a, b] = w[b, a] = max(w.get((a, b), 0.0), x)
    out = {n: sum(x for (a, _), x in w.items() if a == n) for n in nodes}
    seeds = [n for n in nodes if n.endswith("_c00000")]
    r = {n: (n in seeds) / len(seeds) for n in nodes}
    x = {n: 1 / len(nodes) for n in nodes}
    for _ in range(400):
        lost = sum(x[n] for n in nodes if not out[n])
        new = {n: 0.15 * r[n] + 0.85 * lost * r[n] for n in nodes}
        for (a, b), v in w.items():
            new[b] += 0.85 * x[a] * v / out[a]
        moved, x = sum(abs(new[n] - x[n]) for n in nodes), new
        if moved < 1e-14:
            break
    got = {row["node_id"]: row["x"] for row in Q.queries()["converged_pagerank"](spark, d).collect()}
    assert got == pytest.approx(x, abs=1e-9)
    assert got["chunk:0_c00007"] > 0  # seven edges from the only seed of its document


def test_lines_and_names_with_the_defaults(spark, tmp_path):
    texts = [
        "Marie Curie met  McDonald\u00a0and \u201cVi\u00e8le\u201d\r\n\r\n\uff21cme\u2014Corp \u2026 end",
        "first\n\n" + " ".join(f"w{i}" for i in range(1000)) + "\n\u4e2d\u6587\u540d\u5b57 saw AT&T Labs",
    ]
    d = tables(spark, tmp_path / "t", texts)
    lines, want = {}, set()
    for doc, text in enumerate(texts):
        rows = []
        for n, raw in enumerate(re.split("\r\n?|\n", text), 1):
            t = unicodedata.normalize("NFKC", raw).translate(str.maketrans("\u2018\u2019\u201c\u201d\u2013\u2014\u2212", "''\"\"---")).replace("\u2026", "...")
            words = re.sub("[ \t]{2,}", " ", t).strip().split(" ")
            parts = [" ".join(words[i : i + 384]) for i in range(0, len(words), 384)] if len(words) > 384 else [" ".join(words)]
            rows += [(n, p) for p in parts if p]
        if len(rows) > len({n for n, _ in rows}):
            rows = [(i, p) for i, (_, p) in enumerate(rows, 1)]
        lines[doc] = rows
        want |= {(doc, n, p) for n, p in rows}
    got = {tuple(r) for r in Q.queries()["normalized_lines"](spark, d).collect()}
    assert got == want and max(n for doc, n, _ in got if doc == 1) == 5
    pattern = re.compile(r"\b[A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,4}\b|[\u4e00-\u9fff]{2,12}")
    names, pairs = set(), set()
    for rows in lines.values():
        for i in range(0, len(rows), 4):
            found = [x.strip(" .,:;!?()[]{}") for x in pattern.findall("\n".join(t for _, t in rows[i : i + 4]))]
            found = list(dict.fromkeys(x for x in found if len(x) >= 2))[:8]
            names |= set(found)
            pairs |= {frozenset(p) for p in zip(found, found[1:])}
    rows = Q.queries()["phrase_entities"](spark, d).collect()
    by_id = {r["entity_id"]: r["name"] for r in rows}
    assert set(by_id.values()) == names >= {"Marie Curie", "McDonald", "AT&T Labs", "\u4e2d\u6587\u540d\u5b57"} and not names & {"Vi", "Mc", "Donald"}
    assert {frozenset((by_id[r["source"]], by_id[r["target"]])) for r in Q.queries()["phrase_relations"](spark, d).collect()} == pairs


def test_reach_context_and_read(spark, tmp_path):
    texts = ["\n".join(f"plain {i}" for i in range(32)) + "\nneedle", "short"]
    asked = spark.createDataFrame([(0, "needle")], "item_id long, text string")
    d = tables(spark, tmp_path / "t", texts, benchmark=asked)
    q = Q.queries()
    assert {tuple(r) for r in q["whole_reachability"](spark, d).collect()} == {(f"chunk:0_c{i:05d}", i) for i in range(9)}
    assert {tuple(r) for r in q["hit_context"](spark, d).collect()} == {("0_c00007", -1), ("0_c00008", 0)}
    rows = texts[0].split("\n")
    want = {(f"doc_0.txt:L{4 * (i // 4) + 1}-L{min(4 * (i // 4) + 4, 33)}", i + 1, f"{i + 1:6d} | {t}") for i, t in enumerate(rows)}
    assert {tuple(r) for r in q["read_locates"](spark, d).collect()} == want | {("doc_1.txt:L1-L1", 1, "     1 | short")}


def test_embeddings_and_bootstrap_in_full(spark, tmp_path):
    rng = np.random.default_rng(3)
    labels = spark.createDataFrame([(i % 2, int(x)) for i, x in enumerate(rng.integers(0, 2, 400))], "toxic int, quality int")
    d = tables(spark, tmp_path / "t", [" ".join(f"w{i}" for i in range(300)), "one Two two"], labels=labels)
    want = np.zeros((2, 128))
    for doc, text in enumerate([" ".join(f"w{i}" for i in range(300)), "one Two two"]):
        for tok in text.lower().split():
            h = hashlib.sha256(tok.encode()).hexdigest()
            want[doc, int(h[:8], 16) % 128] += 1 if int(h[8:10], 16) % 2 == 0 else -1
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.zeros((2, 128))
    for r in Q.queries()["text_embeddings"](spark, d).collect():
        got[r["doc_id"], r["i"]] = r["x"]
    assert got == pytest.approx(want)
    pairs = labels.select("toxic", F.col("quality").alias("value"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    full, few = rows(E.bootstrap(pairs, "toxic", n_boot=10_000)), rows(E.bootstrap(pairs, "toxic", n_boot=2000))
    assert rows(Q.queries()["bootstrap_intervals"](spark, d)) == full != few
