"""Queries of grouped retrieval from real hits, with online ranks, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import blockmax as X
from corpusloom.operators import graphs as G
from corpusloom.operators import push as U
from corpusloom.operators import retrieval as R
from corpusloom.operators import search as S
from corpusloom.plans import base as B
from corpusloom.plans.tables import run_folder, stored
from corpusloom.queries import _BM25, _questions, query
from corpusloom.queries_search import _field_sql
from corpusloom.sources import index as S_index

_K = 5
_TOLERANCE = 1e-6


def _summaries(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A summary of each document's chunks by their first lines, and one of each eight documents by their titles; structure edges."""
    lines = F.array_sort(F.collect_list(F.struct("chunk_index", F.split("content", "\n")[0].alias("line"))))
    own = F.concat(F.lit("summary:d"), F.col("doc_id").cast("string"))
    docs = named.groupBy("doc_id", F.col("file_name").alias("title")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
    group = F.concat(F.lit("summary:g"), F.expr("doc_id div 8").cast("string"))
    names = F.array_sort(F.collect_list(F.struct("doc_id", "title")))
    tops = docs.groupBy(group.alias("node_id")).agg(F.array_join(F.transform(names, lambda x: x["title"]), "\n").alias("content"))
    first = docs.select(own.alias("node_id"), "title", "content")
    out = first.unionByName(tops.select("node_id", F.col("node_id").alias("title"), "content"))
    edges = named.select(own.alias("source"), F.concat(F.lit("chunk:"), "chunk_id").alias("target"))
    edges = edges.unionByName(docs.select(group.alias("source"), own.alias("target")))
    return out, edges.select("source", "target", F.lit("structure").alias("edge_type"), F.lit(1.0).alias("weight"))


class _Corpus:
    """The stored graph of the tables, with summaries, and what is searched in it."""

    def __init__(self, spark: SparkSession, d: str):
        self.named = stored(B.named(spark, d))
        mentions, related = stored(G.mentions(self.named)), stored(G.co_occurrences(self.named))
        self.entities, self.relations = stored(G.merge_entities(mentions)), stored(G.merge_relations(related))
        self.summaries, structure = (stored(x) for x in _summaries(self.named))
        sequence = G.sequence_edges(G.sequence_nodes(self.named)).where("direction = 'next'")
        one = F.lit(1.0).alias("weight")
        self.edges = stored(
            self.relations.select("source", "target", F.lit("semantic").alias("edge_type"), "weight")
            .unionByName(G.source_edges(mentions, related).select("source", "target", "edge_type", one))
            .unionByName(sequence.select("source", "target", "edge_type", one))
            .unionByName(structure)
        )
        kind = lambda df, c, t: df.select(F.col(c).alias("node_id"), F.lit(t).alias("node_type"))
        chunks = self.named.select(F.concat(F.lit("chunk:"), "chunk_id").alias("node_id"), F.lit("chunk").alias("node_type"))
        self.nodes = stored(chunks.unionByName(kind(self.entities, "entity_id", "entity")).unionByName(kind(self.summaries, "node_id", "summary")))
        self.docs = stored(S_index.graph_documents(self.entities, self.relations, self.summaries))

    def hits(self, asked: DataFrame) -> DataFrame:
        """The grouped hits of all questions: query_id, id, scene, retrieval_type, pos."""
        texts = self.named.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
        chunks = R.bm25_top_k(texts, asked, _K).select("query_id", F.concat(F.lit("chunk:"), "id").alias("id"), "rank")
        summaries = S.search_graph(self.docs, asked, _K, mode="bm25", object_types=["summary"])
        graph = S.search_graph(self.docs, asked, _K, mode="bm25", object_types=["entity", "relation"])
        graph = graph.join(self.docs.select("id", "object_type"), "id")
        return stored(S.grouped(S.tagged(chunks, "chunk"), S.tagged(summaries, "summary"), S.tagged(graph, F.col("object_type"))))

    def seeds(self, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Seeds of the text and of the graph scene; a relation stands for its first end that is known."""
        edge = T.edge_id(F.lit("semantic"), F.col("relation_types"), F.col("source"), F.col("target"))
        ends = self.relations.select(edge.alias("id"), "source", "target")
        rows = hits.join(ends, "id", "left")
        return tuple(U.seeds_of(rows.where(F.col("scene") == s), self.nodes) for s in ("text", "graph"))


_SUMMED = f"""{B.RELATIONS},
sd as (select doc_id, file_name title, string_agg(string_split(content, chr(10))[1], chr(10) order by chunk_index) as content from c group by all),
sm as (select 'summary:d' || doc_id node_id, title, content from sd union all
  select 'summary:g' || doc_id // 8, 'summary:g' || doc_id // 8, string_agg(title, chr(10) order by doc_id) from sd group by doc_id // 8),
ent as (select entity_id id, arg_min(name, (chunk_id, pos)) as name from m group by entity_id),
ety as (select entity_id id, arg_min(entity_type, (-k, f)) ty from (select entity_id, entity_type, count(*) k, min((chunk_id, pos)) f from m group by all) group by entity_id),
rl as (select 'edge:' || substr(sha1('{{"edge_type": "semantic", "relation_types": ["co_occurs"], "source": "' || source || '", "target": "' || target || '"}}'), 1, 16) id, source, target,
  coalesce(a.name, source) || ' -> ' || coalesce(b.name, target) as name from rel left join ent a on a.id = source left join ent b on b.id = target),
dd as (select id, 'entity' object_type, name, null::varchar title, name || chr(10) || ty as content from ent join ety using (id)
  union all select id, 'relation', name, null, name || chr(10) || 'co_occurs' from rl
  union all select node_id, 'summary', null, title, case when contains(content, title) then content else title || chr(10) || content end from sm)"""


def _graph_hits_sql(p: str, where: str, fields: tuple[str, ...]) -> str:
    """The best of each object by its best field, as {p}h: query_id, id, rank."""
    boost = {"name": 2.0, "title": 2.0, "content": 1.0}
    parts = ", ".join(_field_sql(f"coalesce({f}, '')", boost[f], where, 4 * _K, p + f[:2]) for f in fields).replace("join qf using", "join qt using")
    rows = " union all ".join(f"select * from {p}{f[:2]}r" for f in fields)
    return f"""{parts}, {p}w as (select query_id, id, max(score) score from ({rows}) group by all),
{p}k as (select * from {p}w qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= {4 * _K}),
{p}h as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from {p}k qualify rank <= {_K})"""


_HITS = f"""{_SUMMED}, {_BM25}, qt as (select query_id, token tok, qtf from qf),
{_graph_hits_sql("s", "object_type = 'summary'", ("title", "content"))}, {_graph_hits_sql("g", "object_type <> 'summary'", ("name", "content"))},
hi as (select query_id, 'chunk:' || id id, rank, 'chunk' retrieval_type, 'text' scene, 0 no from b where rank <= {_K}
  union all select query_id, id, rank, 'summary', 'text', 1 from sh
  union all select query_id, id, rank, object_type, 'graph', 2 from gh join dd using (id)),
gr as (select query_id, id, retrieval_type, scene, row_number() over (partition by query_id, scene order by no, rank) pos from hi)"""


@query(f"with {_HITS} select query_id, id, retrieval_type, scene, pos from gr")
def grouped_search(spark, d):
    """Both result groups of every question from searches of chunks, summaries, entities and relations."""
    found = _Corpus(spark, d).hits(_questions(spark, d))
    return found.select("query_id", "id", "retrieval_type", "scene", F.col("pos").cast("long").alias("pos"))


def _push_sql(damping: float, tolerance: float) -> str:
    rounds = -(-U.least_rounds(damping, tolerance) // 3) * 3
    pairs = U.momentum(damping, rounds)
    keep, gain = ([repr(x[i]) + "::double" for x in pairs] for i in (0, 1))
    p = f"case when abs(s.p) > {tolerance * 1e-4!r} then s.p else 0 end"
    return f"""
nd as (select 'chunk:' || chunk_id node_id, 'chunk' node_type from c union all select id, 'entity' from ent union all select node_id, 'summary' from sm),
st as (select 'summary:d' || doc_id as source, 'chunk:' || chunk_id as target from c union all select 'summary:g' || doc_id // 8, 'summary:d' || doc_id from sd),
we as (select source, target, greatest(weight, 1) w from rel union all select distinct entity_id, 'chunk:' || chunk_id, 1.0 from m
  union all select 'chunk:' || chunk_id, 'chunk:' || next_chunk_id, 1.0 from c where next_chunk_id is not null union all select source, target, 1.0 from st),
adj as (select a, b, max(w) w, bool_or(a like 'summary:%' or b like 'summary:%') s from (select source a, target b, w from we where source <> target union all select target, source, w from we where source <> target) group by all),
sd0 as (select distinct scene, query_id, coalesce(n.node_id, r.source) node_id from gr left join nd n on n.node_id = gr.id left join rl r on r.id = gr.id),
up as (select query_id, node_id from sd0 where scene = 'text' union select up.query_id, st.source from up join st on st.target = up.node_id),
dw as (select query_id, node_id from sd0 where scene = 'text' and node_id like 'summary:%' union select dw.query_id, st.target from dw join st on st.source = dw.node_id),
sc as (select 'text' scene, * from (select * from up union select * from dw) where node_id like 'summary:%'),
sv as (select scene, query_id, node_id, 1.0 / count(*) over (partition by scene, query_id) r from sd0 where node_id is not null and (scene = 'text' or node_id not like 'summary:%')),
ex as (select x.scene, x.query_id, a, b, w from adj join sc x on x.node_id = a where s and b not like 'summary:%'
  union all select x.scene, x.query_id, a, b, w from adj join sc x on x.node_id = b where s and a not like 'summary:%'
  union all select x.scene, x.query_id, a, b, w from adj join sc x on x.node_id = a join sc y on y.node_id = b and y.scene = x.scene and y.query_id = x.query_id where a like 'summary:%' and b like 'summary:%'),
tb as (select a, sum(w) t from adj where not s group by a), te as (select scene, query_id, a, sum(w) e from ex group by all),
steps as (select null scene, null query_id, a, b, w / t share, false own from adj join tb using (a) where not s
  union all select scene, query_id, a, b, w / (e + coalesce(t, 0)), true from ex join te using (scene, query_id, a) left join tb using (a)
  union all select null, null, node_id, node_id, null, null from nd),
pr as (select 0 i, scene, query_id, node_id, 0.0::double x, {1 - damping!r} * r r, {1 - damping!r} * r p from sv
  union all
  select i + 1, scene, query_id, node_id, sum(x), sum(r), [{", ".join(keep)}][i + 1] * sum(p) + [{", ".join(gain)}][i + 1] * sum(r) from (
    select s.i, s.scene, s.query_id, t.b node_id, case when own is null then s.x + {p} else 0 end x,
      case when own is null then s.r - {p} when own then {damping} * {p} * share else {damping} * {p} * share * coalesce(tb.t / (e + tb.t), 1) end r,
      case when own is null then {p} else 0 end p
    from pr s join steps t on t.a = s.node_id and (t.scene is null or t.scene = s.scene and t.query_id = s.query_id)
    left join te on te.a = s.node_id and te.scene = s.scene and te.query_id = s.query_id left join tb on tb.a = s.node_id
    where s.i < {rounds} and (own is null or abs(s.p) > {tolerance * 1e-4!r}))
  group by i, scene, query_id, node_id),
rk as (select *, x / sum(x) over (partition by scene, query_id) y from pr where i = {rounds}),
top_ as (select scene, query_id, node_id id, y score, row_number() over (partition by scene, query_id order by round(y, 9) desc, node_id) as rank from rk
  where node_id like 'entity:%' and (scene, query_id, node_id) not in (select scene, query_id, node_id from sv) qualify rank <= {_K})"""


@query(f"with recursive {_HITS}, {_push_sql(0.85, _TOLERANCE)} select scene, query_id, id, round(score, 8) score, rank from top_")
def online_suggestions(spark, d):
    """Entities to jump to from either result group of every question, by rank from the group's own hits."""
    corpus = _Corpus(spark, d)
    found = U.suggest(corpus.nodes, corpus.edges, *corpus.seeds(corpus.hits(_questions(spark, d))), _K, checkpoint=stored, tolerance=_TOLERANCE)
    return found.select("scene", "query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {B.CHUNKS}, {_BM25} select query_id, id, rank, round(score, 6) score from b")
def indexed_bm25(spark, d):
    """BM25 of all questions over an index of all chunks, which is written once and opened where it matters."""
    path = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    X.write(B.chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), path)
    found, _ = X.search(X.read(spark, path), _questions(spark, d), 10, checkpoint=stored)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))
