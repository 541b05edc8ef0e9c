"""Steps of round 3's findings, against the plainer steps they replace."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import graphs as G
from corpusloom.operators import paths as P
from corpusloom.operators import products as K
from corpusloom.operators import push as U
from corpusloom.operators import retrieval as R
from corpusloom.plans.tables import stored


def test_reach_ahead_is_reach_over_next_edges_without_rounds(spark):
    rows = [(f"{d}_c{i:05d}", d, i * 4, i * 4 + 3) for d, n in ((1, 1), (2, 5), (3, 9), (None, 3)) for i in range(n)]
    nodes = stored(G.sequence_nodes(spark.createDataFrame(rows, "chunk_id string, doc_id long, start_line int, end_line int")))
    seeds = nodes.where("chunk_id in ('1_c00000', '2_c00000', '3_c00002', '3_c00006', 'None_c00000')").select("node_id")
    edges = G.sequence_edges(nodes).where("direction = 'next'").select("source", "target")
    linked = seeds.join(edges.select(F.col("source").alias("node_id")), "node_id", "left_semi")
    want = P.reach(edges, linked.select(F.lit(0).alias("query_id"), "node_id"), hops=None, checkpoint=stored).select("node_id", "depth")
    spark.sparkContext.setJobGroup("ahead", "")
    got = sorted(G.reach_ahead(nodes, seeds).collect())
    calls = spark.sparkContext.statusTracker().getJobIdsForGroup("ahead")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(want.collect()) and len(got) == 15
    assert len(calls) < 9  # a round each of the longest document's chunks before


def test_documents_become_objects_one_at_a_time():
    seen, limit = [], 1000

    def make(row):
        seen.append(row["n"])
        yield from ({"text": "x" * 50} for _ in range(row["n"]))

    batch = pa.RecordBatch.from_pylist([{"n": n} for n in (3, 0, 40, 1)])
    out = D.row_by_row(make, pa.schema({"text": pa.string()}), "text", most=limit)(iter([batch, batch]))
    first = next(out)
    assert seen == [3, 0, 40] and first.num_rows == 7  # the rest of the batch waits, and no more than the limit was held
    rest = list(out)
    assert first.num_rows + sum(b.num_rows for b in rest) == 88 and max(b.num_rows for b in rest) <= 7


def test_block_products_are_the_ranks_by_rows(spark):
    rng = random.Random(3)
    number = lambda i: (i % 3 << 33) + (i % 2) * 70000 + i  # noqa: E731  as partitions of numbers have them, over several blocks
    edges = [(number(rng.randrange(60)), number(rng.randrange(60)), float(rng.randrange(1, 5))) for _ in range(150)]
    adj = stored(P.adjacency(spark.createDataFrame(edges, "source long, target long, weight double")))
    ids = [number(i) for i in range(64)]  # four without edges, one of them a seed
    nodes = spark.createDataFrame([(i, 0.25 if k in (0, 7, 33, 62) else 0.0) for k, i in enumerate(ids)], "node_id long, r double")
    restart = nodes.where("r > 0").select(F.lit(0).alias("query_id"), "node_id", "r")
    want = {r["node_id"]: r["x"] for r in P.pagerank(adj, nodes.select(F.lit(0).alias("query_id"), "node_id"), restart, rounds=5, checkpoint=stored).collect()}
    got = {r["node_id"]: r["x"] for r in K.rounds(adj, nodes, 5, checkpoint=stored).collect()}
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-14
    want = {r["node_id"]: r["x"] for r in U.forward_push(adj, restart, checkpoint=stored, tolerance=1e-5).collect()}
    got = {r["node_id"]: r["x"] for r in K.converged(adj, nodes, checkpoint=stored, tolerance=1e-5).collect()}
    assert sum(abs(got[i] - want.get(i, 0.0)) for i in ids) < 3e-5
    most = K.product(K.tiles(adj), spark.createDataFrame([], "block long, v binary"))
    assert most.count() == 0 and K.tiles(adj).count() <= 36  # rows of a round: tiles, not edges


def test_dense_scores_by_blocks_of_queries(spark):
    vectors = {1: [1.0, 2.0], 2: [0.5, -1.0], 3: None, 4: [None, 1.0], 5: [3.0], 6: [], 7: [0.0, 4.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    queries = df.where("id <> 7").select((F.col("id") * 10).alias("query_id"), "vector")
    dot = lambda a, b: None if a is None or b is None or len(a) != len(b) or None in a + b else float(sum(x * y for x, y in zip(a, b, strict=True)))
    want = {(q * 10, i, dot(vectors[q], v)) for q in vectors if q != 7 for i, v in vectors.items()}
    found = R.dense_scores(df, queries, block=2)
    assert {tuple(r) for r in found.collect()} == want
    plain = queries.withColumnRenamed("vector", "qv").join(df).select("query_id", "id", T.dot(F.col("vector"), F.col("qv")).alias("score"))
    assert {tuple(r) for r in plain.collect()} == want
    assert "Nested" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_similar_pairs_grow_with_the_vectors():
    assert [R.block_size(n, 256) for n in (0, 2000, 100_000, 600_000, 10**7)] == [256, 256, 1563, 9375, 65536]


def test_similar_pairs_in_few_scores_at_a_time(spark):
    rows = [(i, [1.0 + i % 5, 2.0, float(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    whole, few = (sorted(tuple(r)[:2] + (r["rank"],) for r in R.similar_pairs(df, 0.9, 3, checkpoint=stored, block=8, pivots=2, cells=n).collect()) for n in (1 << 22, 16))
    assert len(whole) == 180 and few == whole


def test_hash_vectors_are_the_embeddings_hashed_once_a_word(spark):
    texts = [(1, "One two  one\u00a0\u4e09 TWO"), (2, None), (3, ""), (4, " \n "), (5, "x y"), (5, "x y"), (None, "\u0130 caf\u00e9\u2003z"), (7, "a " * 3000 + "b")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    want = df.select("doc_id", F.posexplode(T.hash_embedding(F.col("text"), 128)).alias("i", "x")).where("x <> 0")
    found = R.hash_vectors(df, 128, id_col="doc_id")
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
