"""Small fixtures with known results for operators that SQL cannot express, and round trips of sources."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cues as C
from corpusloom.operators import documents as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import graphs as G
from corpusloom.operators import paths as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as S
from corpusloom.plans.tables import stored
from corpusloom.sources import files, index
from corpusloom.streaming import ingest


def parse(spark, text, **kw):
    docs = spark.createDataFrame([("d1", "m.md", text)], "doc_id string, file_name string, text string")
    lines = D.lines(docs, **kw)
    return lines, D.heading_parents(D.content_ranges(D.headings(lines), lines))


def test_lines_keep_numbers_unless_one_is_split(spark):
    lines, _ = parse(spark, "one\n\n two  x \n![i](a.png)")
    assert [(r["line_no"], r["text"]) for r in lines.orderBy("line_no").collect()] == [(1, "one"), (3, "two x"), (4, "![i](a.png)")]
    lines, _ = parse(spark, "one\n\n" + " ".join(["w"] * 10), max_line_tokens=4)
    assert [(r["line_no"], r["text"]) for r in lines.orderBy("line_no").collect()] == [(1, "one"), (2, "w w w w"), (3, "w w w w"), (4, "w w")]


def test_chunks_follow_the_tree(spark):
    text = "before\n# A\na1 a2\n## B\nb1 b2 b3\n# C\nc"
    lines, tree = parse(spark, text)
    paths = {r["line_no"]: (r["section_path"], r["end_line"], r["parent_line"]) for r in tree.collect()}
    assert paths == {2: (["A"], 5, None), 4: (["A", "B"], 5, 2), 6: (["C"], 7, None)}
    got = D.chunk(lines, tree, max_tokens=100).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["start_line"], r["end_line"], r["merge"]) for r in got] == [("d1_c00000", 2, 5, "subtree"), ("d1_c00001", 6, 7, "subtree")]
    assert got[0]["content"].startswith("A\n\n[CONTENT]\n\n# A") and got[0]["next_chunk_id"] == "d1_c00001"
    small = D.chunk(lines, tree, max_tokens=8, overlap_tokens=0).orderBy("chunk_index").collect()
    # a section above the budget is split whole, and its children come again
    assert [(r["section_path"], r["start_line"], r["end_line"], r["merge"]) for r in small] == [
        (["A"], 2, 4, "split"), (["A"], 5, 5, "split"), (["A", "B"], 4, 5, "subtree"), (["C"], 6, 7, "subtree"),
    ]


def test_long_lines_are_windows_with_overlap(spark):
    lines, tree = parse(spark, "# H\n" + " ".join(f"w{i}" for i in range(60)), max_line_tokens=0)
    got = D.chunk(lines, tree, max_tokens=20, overlap_tokens=2).collect()
    assert len(got) > 1 and all(r["token_count"] <= 35 for r in got) and any(r["merge"] == "split_long_line" for r in got)
    assert list(D.pack_words(["a", "b", "c"], 2, lambda w: 1, 1)) == ["a b", "b c"]
    assert list(D.pack_words(["abcde"], 2, len)) == ["ab", "cd", "e"]


def test_summaries(spark):
    lines, tree = parse(spark, "# A\na\n## B\nb\n# C\nc")
    chunks = D.chunk(lines, tree, max_tokens=3, overlap_tokens=0)
    nodes = {r["title"]: r for r in S.structure_nodes(chunks, tree).collect()}
    assert set(nodes) == {"A", "B", "C", "m.md"}
    assert nodes["B"]["parent_node_id"] == nodes["A"]["node_id"] and nodes["A"]["parent_node_id"] == nodes["m.md"]["node_id"]
    assert nodes["m.md"]["level"] == 0 and nodes["m.md"]["mode"] == "document_tree_root"
    flat = spark.createDataFrame([("d", "f", f"d_c{i}", i, i, f"text {i}") for i in range(5)], "doc_id string, file_name string, chunk_id string, start_line int, end_line int, content string")
    made = S.structure_nodes(flat, tree, cluster_token_budget=4).collect()
    assert sorted(r["level"] for r in made) == [1, 1, 1, 2, 2, 3] and {r["mode"] for r in made} == {"standard_raptor"}


def test_pagerank_fixture(spark):
    nodes = [(1, n) for n in ("c1", "c2", "e1", "e2", "e3")]
    edges = [("e1", "c1", "source", 1.0), ("e2", "c1", "source", 1.0), ("e1", "e2", "semantic", 3.0), ("e1", "e3", "semantic", 1.0)]
    e = spark.createDataFrame(edges, "source string, target string, edge_type string, weight double")
    n = spark.createDataFrame(nodes, "query_id int, node_id string")
    r = spark.createDataFrame([(1, "e1", 1.0)], "query_id int, node_id string, r double")
    adj = P.adjacency(e)
    scope = n.join(r, ["query_id", "node_id"], "left").fillna(0.0, ["r"])
    pairs = adj.where("a < b").withColumn("query_id", F.lit(1))
    x = {row["node_id"]: row["x"] for row in P.pagerank_grouped(pairs, scope).collect()}
    assert x == pytest.approx({"c1": 0.144613, "c2": 0, "e1": 0.472575, "e2": 0.302474, "e3": 0.080338}, abs=1e-6)
    assert sum(x.values()) == pytest.approx(1)
    few = {row["node_id"]: row["x"] for row in P.pagerank_grouped(pairs, scope, rounds=6).collect()}
    wide = {row["node_id"]: row["x"] for row in P.pagerank(adj, n, r, rounds=6, uniform_start=True, checkpoint=stored).collect()}
    assert wide == pytest.approx(few)


def test_merges_and_provenance(spark):
    rows = [("c1", "d", "f", 1, 2, ["Ann", "Bob"]), ("c2", "d", "f", 3, 4, ["bob ", "Cy"])]
    n = spark.createDataFrame(rows, "chunk_id string, doc_id string, file_name string, start_line int, end_line int, names array<string>")
    ents = {r["name"]: r for r in G.merge_entities(G.mentions(n)).collect()}
    assert set(ents) == {"Ann", "Bob", "Cy"} and ents["Bob"]["source_chunk_ids"] == ["c1", "c2"]
    rel = G.co_occurrences(n).unionByName(G.co_occurrences(n).withColumns({"source": F.col("target"), "target": F.col("source")}))
    merged = G.merge_relations(rel).collect()
    assert len(merged) == 2 and all(r["weight"] == 2.0 for r in merged)
    only = G.mentions(n.where("chunk_id = 'c1'"))
    holes = G.placeholder_entities(G.co_occurrences(n), only).collect()
    assert [(r["name"], r["entity_type"], r["auto_created"]) for r in holes] == [("Cy", "UNKNOWN", True)]


def test_locates_merge_when_they_touch(spark):
    df = spark.createDataFrame([("o", "a:L1-L2"), ("o", "a:L3-L4"), ("o", "a:L9-L9"), ("o", "b:L1-L1"), ("o", "odd")], "object_id string, locate string")
    assert sorted(r["locate"] for r in C.merge_locates(df).collect()) == ["a:L1-L4", "a:L9-L9", "b:L1-L1", "odd"]


def test_greedy_coverage_and_navigation(spark):
    cues = [("o", "semantic", "a", 0.5, 1.0, ["u", "v"]), ("o", "semantic", "b", 0.9, 1.0, ["u"]), ("o", "semantic", "c", 0.1, 1.0, ["w"]), ("o", "semantic", "d", 1.0, 1.0, [])]
    df = spark.createDataFrame(cues, "object_id string, family string, cue_id string, score double, weight double, units array<string>")
    assert [r["cue_id"] for r in C.select_greedy(df, 5).orderBy("pick").collect()] == ["a", "c"]
    q = spark.createDataFrame(
        [(1, [(0.9, "c1"), (0.7, "e1")], [("c1", "provenance", 0, None, "f:L1-L2"), ("c1", "horizontal", 0, "c2", None), ("e1", "semantic", 0, "e2", None), ("c2", "provenance", 0, None, "f:L3-L4")])],
        "question_id long, frontier array<struct<score: double, id: string>>, cues array<struct<object_id: string, family: string, pos: int, target_id: string, locate: string>>",
    )
    steps = [(r["kind"], r["what"]) for r in C.chain(q, max_hops=4).orderBy("step").collect()]
    assert steps == [("expand", "c1"), ("read", "f:L1-L2"), ("expand", "e1"), ("expand", "c2"), ("read", "f:L3-L4"), ("expand", "e2")]
    assert C.chain(q, max_hops=1).where("kind = 'expand'").count() == 1
    assert C.chain(q, read_budget=1, max_hops=5).where("kind = 'read'").count() == 1


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", "cat")], "id string, text string")
    q = spark.createDataFrame([(1, "red cat")], "query_id int, text string")
    got = {r["id"]: r["score"] for r in R.bm25(R.postings(docs), q).collect()}
    idf = lambda df: np.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got == pytest.approx({"a": idf(2) * part(1, 2), "b": idf(2) * part(2, 3), "c": idf(1) * part(1, 1)})
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    assert [r["id"] for r in R.rrf([a, b], 3).orderBy("rank").collect()] == ["y", "x", "z"]


def test_statistics(spark):
    v = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 1.0), ("c", None)], "g string, value double")
    got = {r["g"]: r for r in E.bootstrap(v, "g", n_boot=500).collect()}
    assert got["a"]["low"] < got["a"]["mean"] == 24.5 < got["a"]["high"]
    assert (got["b"]["low"], got["b"]["high"]) == (1, 1) and (got["c"]["n"], got["c"]["mean"]) == (0, 0)
    same = spark.createDataFrame([("a", float(i), float(i)) for i in range(9)], "g string, a double, b double")
    r = E.paired_bootstrap(same, "g", n_boot=200).first()
    assert (r["diff"], r["low"], r["high"]) == (0, 0, 0)
    x = E.break_even(spark.createDataFrame([(1000.0, 0.0, 50.0, 100.0)], "offline double, base_offline double, online double, base_online double")).first()
    assert x["break_even"] == 20


def test_sources(spark, tmp_path):
    at = f"file://{tmp_path}/q.jsonl"
    rows = spark.createDataFrame([("q1", "é"), ("q2", None)], "id string, t string")
    assert files.write_jsonl(rows, at) == 2
    assert files.read_jsonl(spark, at, "id string, t string").orderBy("id").collect() == rows.collect()
    assert files.read_jsonl(spark, f"{at}.none", "id string", missing_ok=True).count() == 0
    with open(tmp_path / "bad.jsonl", "w") as f:
        f.write('{"id": "a"}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "id string").collect()
    loose = files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "id string", strict=False).collect()
    assert [r["_bad"] for r in loose] == [None, "not json"]
    repo = files.Repository(spark, f"file://{tmp_path}", "ns")
    repo.save("g", rows)
    assert repo.exists("g") and not repo.exists("h") and repo.load("g").count() == 2
    new = spark.createDataFrame([("q2", "new"), ("q3", "x")], "id string, t string")
    assert {r["id"]: r["t"] for r in files.upsert(rows, new, ["id"]).collect()} == {"q1": "é", "q2": "new", "q3": "x"}
    j = spark.createDataFrame([(0, '{"text": " ", "content": "b"}'), (1, '{"z": 1}')], "i int, j string")
    assert [r[0] for r in j.orderBy("i").select(files.text_of_json(F.col("j"))).collect()] == ["b", '{"z": 1}']
    a = spark.createDataFrame([(0, None), (1, '["x","y"]'), (2, "z")], "i int, a string")
    assert [r[0] for r in a.orderBy("i").select(files.normalize_answers(F.col("a"))).collect()] == [[], ["x", "y"], ["z"]]
    w = spark.createDataFrame([("r", '{"k": [{"text": "a", "id": 7}, {"z": {"content": "b"}}]}')], "root string, json string")
    assert [tuple(r) for r in files.walk_corpus(w).collect()] == [("7", "a"), ("r/k/1/z", "b")]
    docs = spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc_id string, text string")
    qs = spark.createDataFrame([("d1", 0), ("d1", 1), ("d2", 2)], "doc_id string, pos int")
    d, q = files.document_subset(qs, docs, ["d1"], "small", most=1)
    assert d.count() == 1 and [(r["pos"], r["dataset"]) for r in q.collect()] == [(0, "small")]
    with pytest.raises(ValueError):
        files.document_subset(qs, docs, ["d9"], "small")
    files.write_report(rows, f"file://{tmp_path}/r", ["id", "none"])
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).columns == ["id", "none"]
    assert files.markdown_table(rows.orderBy("id"), ["id"]).splitlines()[2] == "| q1 |"


def test_index_documents(spark):
    docs = spark.createDataFrame([("a", "abcdef"), ("b", "xy")], "id string, content string")
    parts = index.vector_parts(docs, spark.createDataFrame([("a", 2)], "id string, n int"))
    got = {r["id"]: (r["content"], r["parent_id"], r["vector_searchable"], r["text_searchable"]) for r in parts.collect()}
    assert got == {"a": ("abcdef", None, False, True), "b": ("xy", None, True, True), "a#0": ("abc", "a", True, False), "a#1": ("def", "a", True, False)}

    def provider():
        def model(texts):
            if len(texts) > 1:
                raise RuntimeError("too many")
            return [[float(len(texts[0]))]]

        return model

    got = index.embed(docs.withColumnRenamed("content", "text"), provider).collect()
    assert {r["id"]: r["vector"] for r in got} == {"a": [6.0], "b": [2.0]}


def test_stream_equals_batch(spark, tmp_path):
    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    os.makedirs(inbox)
    docs = [(f"d{i}", f"d{i}.txt", "Ann met Bob\nBob saw Cy") for i in range(4)]
    for i, d in enumerate(docs):
        spark.createDataFrame([d], "doc_id string, file_name string, text string").coalesce(1).write.mode("append").json(f"file://{inbox}")
        q = ingest.ingest(spark, f"file://{inbox}", out).trigger(availableNow=True).start()
        q.awaitTermination()
    every = spark.createDataFrame(docs, "doc_id string, file_name string, text string")
    batch = G.merge_entities(G.mentions(G.extract(D.line_windows(D.lines(every, max_line_tokens=0), 4))))
    key = lambda df: sorted((r["entity_id"], r["name"], tuple(r["source_chunk_ids"])) for r in df.collect())
    assert key(ingest.entities(spark, out)) == key(batch)
