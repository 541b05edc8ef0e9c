"""Queries of text functions, sources, graph maintenance and model tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cues as C
from corpusloom.operators import documents as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import graphs as G
from corpusloom.operators import models as L
from corpusloom.operators import paths as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as S
from corpusloom.plans import base as B
from corpusloom.plans.tables import stored
from corpusloom.queries import _graph, _questions, _UNIFIED, query
from corpusloom.queries_search import _SHEET, _SHEETS, _sheets
from corpusloom.sources import files as SF
from corpusloom.sources import index as SI

# --- text -----------------------------------------------------------------------------------------------


@query(
    r"""select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) alnum, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim('Host''s "' || url || '"  ok')), '[''’]s\b', '', 'g'), '["''`]', '', 'g'), '\s+', ' ', 'g')) quoteless,
'u:' || md5(url) id, regexp_replace(regexp_replace(lower('-' || url), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') || '_chunks' idx, regexp_replace(trim(url || chr(7) || 'x' || chr(133)), '[\x00-\x1f\x7f-\x{9f}]', '', 'g') clean,
'raptor:' || substr(sha1(url || '|a>b|1,2'), 1, 16) raptor from pages"""
)
def text_keys(spark, d):
    u = F.col("url")
    return B.table(spark, d, "pages").select(
        "page_id", T.alnum_key(u).alias("alnum"), T.quoteless_key(F.concat(F.lit("Host's \""), u, F.lit('"  ok'))).alias("quoteless"), T.md5_id(u, "u:").alias("id"),
        T.index_name(F.concat(F.lit("-"), u), "_chunks").alias("idx"), T.clean_control(F.concat(u, F.lit("\x07x\x85"))).alias("clean"),
        T.raptor_id(u, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))).alias("raptor"),
    )


@query(
    """select item_id, case when item_id % 2 = 0 then '<think>why ' || item_id || '</think>' || chr(10) else '' end || '<answer>' || text || '</answer>' prediction, trim(text) extracted,
'I think' thought, text answer, case when item_id % 2 = 0 then 'a > b' || chr(10) || chr(10) || '[CONTENT]' || chr(10) || chr(10) || text else text end as content,
text || chr(10) || 'x' cleaned, (item_id % 5) / nullif(item_id % 3, 0) ratio, coalesce(try_cast(case when item_id % 2 = 0 then item_id || '.5' else 'n/a' end as double), 0) num from benchmark"""
)
def answer_texts(spark, d):
    b = B.table(spark, d, "benchmark").withColumn("s", F.col("item_id").cast("string"))
    even = F.col("item_id") % 2 == 0
    p = T.prediction_text(F.col("text"), F.when(even, F.concat(F.lit("why "), "s")))
    ta = T.thought_and_answer(F.concat(F.lit(" I think Answer:  "), "text", F.lit(" ")))
    path = F.when(even, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('\\r\\nx"'))
    quoted = F.replace(quoted, F.lit("\n"), F.lit("\\n"))
    return b.select(
        "item_id", p.alias("prediction"), F.trim(T.extract_answer(p)).alias("extracted"), ta["thought"].alias("thought"), ta["answer"].alias("answer"), T.content_with_path(path, F.col("text")).alias("content"),
        T.clean_text(quoted).alias("cleaned"), T.safe_div(F.col("item_id") % 5, F.col("item_id") % 3).alias("ratio"), T.to_number(F.when(even, F.concat("s", F.lit(".5"))).otherwise("n/a")).alias("num"),
    )


@query(
    r"""select event_id, trim(regexp_replace('a  ' || event_type || chr(9) || chr(9) || '“' || event_id || '” – it''s' || '…', '[ \t]{2,}', ' ', 'g')) raw,
'a ' || event_type || ' "' || event_id || '" - it''s...' line, coalesce(try_cast(props ->> '$.k' as bigint), 0) k, 3 items from events"""
)
def normalized_marks(spark, d):
    e = B.table(spark, d, "events")
    raw = F.concat(F.lit("a  "), "event_type", F.lit("\t\t“"), F.col("event_id").cast("string"), F.lit("” – it's…"))
    return e.select(
        "event_id", T.squeeze_line(raw).alias("raw"), T.normalize_line(raw).alias("line"), T.number_or_count(F.get_json_object("props", "$.k")).cast("long").alias("k"), T.number_or_count(F.lit("[1, 2, 3]")).cast("int").alias("items")
    )


#: One line in each heading form, and lines that only look like one.
_FORMS = ("# {1}", "###   {1}  ", "第{0}章、 {1}", "第{0}条 {1}", "第{0}节", "ARTICLE {0}. {1}", "Part {0}", "Section {0}.2: {1}", "{0}.1.3 {1}", "{0} {1}", "#{1}", "chapters {0} {1}")
_EXPECT = (1, 3, 1, 3, 1, 1, 1, 2, 3, None, None, None)


@query(
    "select p_partkey, unnest(range(0, 12)) form, unnest([" + ", ".join("null" if x is None else f"{x}" for x in _EXPECT) + "]) as level, unnest(["
    + ", ".join("'" + {0: "{1}", 1: "{1}"}.get(i, f).replace("{0}", "' || p_partkey || '").replace("{1}", "' || p_name || '") + "'" for i, f in enumerate(_FORMS)) + "]) title from part"
)
def heading_forms(spark, d):
    lines = F.array(*[F.replace(F.replace(F.lit(f), F.lit("{0}"), F.col("p_partkey").cast("string")), F.lit("{1}"), F.col("p_name")) for f in _FORMS])
    rows = B.table(spark, d, "part").select("p_partkey", F.posexplode(lines).alias("form", "line"))
    return rows.select("p_partkey", F.col("form").cast("long").alias("form"), T.heading_level(F.col("line")).alias("level"), T.heading_title(F.col("line")).alias("title"))


@query(
    """with n as (select p_partkey, array_to_string(list_transform(string_split(p_name, ' ')[1:2], lambda w: upper(w[1]) || w[2:]), ' ') as name from part)
select p_partkey, name || ' B' || p_partkey || ' Corp|汉语检索|X&Y-Z' names_, 'OTHER' t1, 'CONCEPT' t2, 'ORG' t3 from n"""
)
def entity_phrases(spark, d):
    name = F.concat(F.initcap(F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ")), F.lit(" B"), F.col("p_partkey").cast("string"), F.lit(" Corp"))
    text = F.concat(F.lit("the "), name, F.lit(" met 汉语检索 and "), name, F.lit(", then X&Y-Z."))
    rows = G.extract(B.table(spark, d, "part").select("p_partkey", text.alias("content")))
    kinds = F.transform("names", T.guess_type)
    return rows.select("p_partkey", F.array_join("names", "|").alias("names_"), kinds[0].alias("t1"), kinds[1].alias("t2"), kinds[2].alias("t3"))


@query("select page_id doc_id, 1 line_no, unnest(['image', 'link']) as type, unnest(['![i](' || url || ')', '[p](' || url || ')']) raw from pages")
def placeholder_lines(spark, d):
    lines = B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("line_no"), F.concat(F.lit("[p]("), "url", F.lit(") ![i]("), "url", F.lit(")")).alias("text"))
    return D.placeholder_rows(lines).select("doc_id", "line_no", "type", "raw")


# --- sources ------------------------------------------------------------------------------------------------


@query("select user_id, string_agg('t' || event_id, chr(10) || chr(10) order by event_id) as text from events group by user_id")
def jsonl_texts(spark, d):
    e = B.table(spark, d, "events")
    json = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("  ").alias("text"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("content")))).otherwise(
        F.to_json(F.struct(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("passage")))
    )
    return SF.text_of_jsonl(e.select("user_id", "event_id", json.alias("json")), "user_id", "event_id", "json")


@query(
    r"""with x as (select event_type || ' ' || user_id % 4 context_id, event_id from events), f as (select context_id, min(event_id) p from x group by all)
select context_id doc_id, substr(regexp_replace('Title / ' || p || ' of ' || context_id, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '.txt' file_name, 'ctx ' || p as text from f"""
)
def prepared_corpus(spark, d):
    e = B.table(spark, d, "events")
    ctx = F.concat("event_type", F.lit(" "), (F.col("user_id") % 4).cast("string"))
    i = F.col("event_id").cast("string")
    rows = e.select(F.col("event_id").alias("pos"), ctx.alias("context_id"), F.concat(F.lit("Title / "), i, F.lit(" of "), ctx).alias("title"), F.concat(F.lit("ctx "), i).alias("context"))
    return SF.prepare_corpus(rows)


@query("with x as (select 'd' || doc_id // 3 doc_id, doc_id pos, coalesce(text, '') as text from documents) select case when row_number() over (partition by doc_id order by pos) = 1 then doc_id else doc_id || '_' || substr(sha1(text), 1, 8) end doc_id, pos from x")
def unique_documents(spark, d):
    rows = B.table(spark, d, "documents").select(F.concat(F.lit("d"), F.expr("doc_id div 3").cast("string")).alias("doc_id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    return SF.unique_ids(rows).select("doc_id", "pos")


@query("select case item_id % 3 when 0 then 'q' || item_id when 1 then 'i' || item_id else substr(sha1(text), 1, 12) end question_id, text question, case item_id % 2 when 0 then 'a' else 'b|c' end answers, case when item_id % 2 = 0 then 'r' else 'x' || chr(10) || 'y' end rationale from benchmark")
def normalized_questions(spark, d):
    b = B.table(spark, d, "benchmark")
    i = F.col("item_id").cast("string")
    even = F.col("item_id") % 2 == 0
    json = F.to_json(F.struct(
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("q"), i)).alias("question_id"), F.when(F.col("item_id") % 3 == 1, F.concat(F.lit("i"), i)).alias("id"),
        F.when(even, F.col("text")).alias("question"), F.when(~even, F.col("text")).alias("query"), F.when(even, "a").alias("answer"),
        F.when(~even, F.array(F.lit("b"), F.lit("c"))).alias("answers"), F.when(even, "r").alias("rationale"), F.when(~even, F.array(F.lit("x"), F.lit("y"))).alias("evidence"),
    ))
    return SF.normalize_questions(b.select(json.alias("json"))).withColumn("answers", F.array_join("answers", "|"))


@query(f"with {B.CHUNKS} select chunk_id id, 'chunk' as type, 'ns' namespace, doc_id, content, token_count, next_chunk_id from c")
def chunk_documents(spark, d):
    return SI.chunk_documents(B.chunks(spark, d), "ns", "ds").select("id", "type", "namespace", "doc_id", "content", F.col("token_count").cast("long").alias("token_count"), "next_chunk_id")


_SUMMARIES = """sm as (select 'sum:' || chunk_id node_id, doc_id || '' title, chunk_index from c where chunk_index % 3 = 0),
st as (select 'sum:' || a.chunk_id as source, 'chunk:' || b.chunk_id as target from c a join c b on b.doc_id = a.doc_id and b.chunk_index // 3 = a.chunk_index // 3 where a.chunk_index % 3 = 0)"""


def _summaries(spark, d):
    c = B.chunks(spark, d)
    head = c.where("chunk_index % 3 = 0")
    nodes = head.select(F.concat(F.lit("sum:"), "chunk_id").alias("node_id"), F.col("doc_id").cast("string").alias("title"), "chunk_index", "doc_id", (F.col("chunk_index") / 3).cast("int").alias("g"))
    kids = c.select(F.col("doc_id"), F.expr("chunk_index div 3").cast("int").alias("g"), F.concat(F.lit("chunk:"), "chunk_id").alias("k"))
    kids = kids.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list("k")).alias("child_node_ids"))
    return nodes.join(kids, ["doc_id", "g"])


@query(f"with {B.CHUNKS}, {_SUMMARIES} select source, target, 'structure' edge_type from st")
def structure_edges(spark, d):
    return S.structure_edges(_summaries(spark, d))


@query(f"with {B.CHUNKS}, {_SUMMARIES} select substr(target, 7) chunk_id, source as parent_summary_id, source as parents from st")
def chunk_parents(spark, d):
    s = _summaries(spark, d)
    p = SI.chunk_parents(S.structure_edges(s), s)
    return p.select("chunk_id", "parent_summary_id", F.array_join("parent_summary_ids", "|").alias("parents"))


@query("select 'o' || o_orderkey id, case when o_orderkey % 4 = 0 then 'part' end parent_id, coalesce(case when o_orderkey % 4 = 0 then 'P' end, o_orderstatus) status from orders")
def hydrated_hits(spark, d):
    o = B.table(spark, d, "orders")
    hits = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "part").alias("parent_id"), F.col("o_orderstatus").alias("status"))
    docs = spark.range(1).select(F.lit("part").alias("id"), F.lit("P").alias("status"))
    return SI.hydrate(hits, docs, ["status"]).select("id", "parent_id", "status")


# --- graphs ---------------------------------------------------------------------------------------------------


@query(f"with {B.CHUNKS}, {_SUMMARIES}, g as (select source node_id, list(target order by target) t from st group by source) select node_id object_id, 'vertical' family, unnest(range(0, len(t))) pos, unnest(t) target_id from g")
def summary_cues(spark, d):
    s = _summaries(spark, d).select("node_id", F.lit(None).cast("string").alias("parent_node_id"), "child_node_ids", F.array().cast("array<string>").alias("source_locates"))
    return C.summary_cues(s).select("object_id", "family", F.col("pos").cast("long").alias("pos"), "target_id")


@query(f"{_UNIFIED} select node_id, case node_type when 'chunk' then 'summary' else 'semantic' end node_type, case node_type when 'chunk' then 'raptor' else 'semantic_relation' end original_node_type from nodes")
def normalized_types(spark, d):
    nodes, _ = _graph(spark, d)
    old = F.when(F.col("node_type") == "chunk", "raptor").otherwise("semantic_relation")
    return G.normalize_types(nodes.withColumn("node_type", old))


@query(f"{_UNIFIED}, en2 as (select source k from edges union select target from edges) select k as key, 'edge without node' issue from en2 where k not in (select node_id from nodes where node_id not like '%_c00000')")
def dangling_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return E.dangling(nodes.where("node_id not like '%_c00000'"), edges)


@query("with x as (select user_id, event_id, event_id * 7 % 50 line_no, lag(event_id * 7 % 50) over (partition by user_id order by event_id) b from events) select distinct user_id || '' as key, 'line numbers fall' issue from x where line_no <= b")
def falling_lines(spark, d):
    e = B.table(spark, d, "events")
    return E.line_order(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 50).alias("line_no")))


@query(f"{_UNIFIED}, sq as (select distinct doc_id query_id from c), sc as (select query_id, node_id from sq join benchmark on item_id = query_id cross join nodes) select query_id, node_id from sc")
def scene_nodes(spark, d):
    nodes, edges = _graph(spark, d)
    asked = _questions(spark, d).select("query_id")  # a question starts from the first chunk of the document of its number
    seeds = asked.select("query_id", F.concat(F.lit("chunk:"), F.col("query_id").cast("string"), F.lit("_c00000")).alias("node_id"))
    seeds = seeds.join(nodes.select("node_id"), "node_id", "left_semi")
    return P.scene_nodes(nodes, edges.select("source", "target", "edge_type"), seeds.select("query_id", "node_id"), scene="text", checkpoint=stored)


@query(
    f"""with {B.RELATIONS}, st as (select 'chunk:' || chunk_id as source, 'chunk:' || next_chunk_id as target, 1.0 / (1 + chunk_index) s from c where next_chunk_id is not null union all
select 'chunk:' || next_chunk_id, 'chunk:' || chunk_id, 0.25 from c where next_chunk_id is not null), s0 as (select doc_id query_id, 'chunk:' || chunk_id id from c where chunk_index = 1),
p1 as (select query_id, [id, target] path, s score, target id from s0 join st on source = id qualify row_number() over (partition by query_id order by s desc, [id, target]) <= 2),
p2 as (select query_id, list_append(path, target) path, score + s score, target id from p1 join st on source = id where not list_contains(path, target) qualify row_number() over (partition by query_id order by score + s desc, list_append(path, target)) <= 2)
select query_id, array_to_string(path, '>') path, round(score, 9) score, 1 depth from p1 union all select query_id, array_to_string(path, '>'), round(score, 9), 2 from p2"""
)
def beam_paths(spark, d):
    c = B.chunks(spark, d)
    a, b = F.concat(F.lit("chunk:"), "chunk_id"), F.concat(F.lit("chunk:"), "next_chunk_id")
    link = c.where("next_chunk_id is not null")
    steps = link.select(a.alias("source"), b.alias("target"), (1.0 / (1 + F.col("chunk_index"))).alias("score")).unionByName(link.select(b.alias("source"), a.alias("target"), F.lit(0.25).alias("score")))
    seeds = c.where("chunk_index = 1").select(F.col("doc_id").alias("query_id"), a.alias("node_id"))
    found = P.beam(stored(steps), seeds, depth=2, width=2)
    return found.select("query_id", F.array_join("path", ">").alias("path"), F.round("score", 9).alias("score"), "depth")


# --- retrieval pieces ------------------------------------------------------------------------------------------


_TERMS3 = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+|[一-鿿]{{2,}}'), lambda x: len(x) >= 2)"


@query(
    f"""with t as (select item_id query_id, unnest({_TERMS3.format('text')}) term from benchmark), p as (select t.query_id, 'p' || p_partkey id, sum((len(p_name) - len(replace(lower(p_name), term, ''))) // len(term)) score from t cross join part group by all)
select query_id, id, score::bigint score from p where score > 0"""
)
def keyword_scores(spark, d):
    docs = B.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text"))
    return R.keyword_scores(docs, _questions(spark, d))


@query(
    """with v as (select vec_id id, list_transform(embedding, lambda x: x::double) x from embeddings) select q.id query_id, v.id, round(list_inner_product(q.x, v.x), 9) score from v q cross join v where q.id % 100 = 0"""
)
def dense_scores(spark, d):
    v = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_scores(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")).select("query_id", "id", F.round("score", 9).alias("score"))


@query("with n as (select distinct p_name as name from part), w as (select distinct upper(p_name) as wanted from part union select 'big ' || p_name from part), k as (select wanted, min(name) nm from w join n on lower(wanted) = name group by all),"
       " t as (select wanted, name, len(list_intersect(string_split(lower(wanted), ' '), string_split(name, ' '))) / len(list_distinct(list_concat(string_split(lower(wanted), ' '), string_split(name, ' ')))) s from w cross join n)"
       " select wanted, coalesce(nm, name) as name from w left join k using (wanted) left join (select * from t where s > 0.5 qualify row_number() over (partition by wanted order by s desc, name) = 1) using (wanted) where coalesce(nm, name) is not null")
def fuzzy_links(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    wanted = p.select(F.upper("name").alias("wanted")).unionByName(p.select(F.concat(F.lit("big "), "name").alias("wanted"))).distinct()
    return R.fuzzy_link(p, wanted).select("wanted", "name")


@query(f"with {B.MENTIONS}, e as (select entity_id, min(name) nm from m group by entity_id) select entity_id, chunk_id, round(ln(1 + (len(content) - len(replace(lower(content), lower(nm), ''))) // len(nm)), 9) bonus from e join c on contains(lower(content), lower(nm))")
def occurrence_bonus(spark, d):
    n = stored(B.named(spark, d))
    names = stored(G.mentions(n).groupBy("entity_id").agg(F.min("name").alias("name")))
    return R.occurrence_bonus(names, n).select("entity_id", "chunk_id", F.round("bonus", 9).alias("bonus"))


@query("with f as (select user_id query_id, event_id % 30 id, min(event_id) pos from events group by all) select query_id, id, row_number() over (partition by query_id order by pos) as rank from f qualify rank <= 5")
def in_order_distinct(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 30).alias("id"), F.col("event_id").alias("pos"))
    return R.in_order_distinct(e, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("select user_id query_id, event_id % 30 id, round(sum(value + 2.0 / (1 + event_id % 7)), 6) score from events where value is not null group by all")
def scores_by_rank(spark, d):
    e = B.table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 30).alias("id"), F.col("value").alias("score"), (1 + F.col("event_id") % 7).alias("rank"))
    return R.score_by_rank(e, F.lit(2.0)).withColumn("score", F.round("score", 6))


# --- models: a deterministic stand-in ------------------------------------------------------------------------------


def shout() -> object:
    """Answers with the prompt's first line in capitals."""
    return lambda prompts: [p.split("\n")[0].upper() for p in prompts]


@query("select item_id || '' id, 'Q' || item_id % 7 answer from benchmark")
def cached_answers(spark, d):
    b = B.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("q"), (F.col("item_id") % 7).cast("string"), F.lit("\nx")).alias("prompt"))
    cache = b.where("id = '3'").select(L.cache_key("m", F.col("prompt")).alias("key"), F.lit("Q3").alias("answer"))
    return L.cached(b, cache, "m", shout)[0]


def scoring() -> object:
    """Scores by the length of the answer and the dimension's first letter."""

    def score(prompt: str) -> int:
        return (len(prompt.split("\nAnswer: ", 1)[1]) + ord(prompt.split(" ")[2][0])) % 10

    return lambda prompts: [f"<score>{score(p)}</score>" for p in prompts]


@query(f"with {{SHEETS}}, j as (select question_id, {{SHEET}} sheet from sh) select question_id, ((len(sheet) + {ord('t')}) % 10) / 10 truth, ((len(sheet) + {ord('s')}) % 10) / 10 as style from j".replace("{SHEETS}", _SHEETS).replace("{SHEET}", _SHEET))
def judged_answers(spark, d):
    rows = _sheets(spark, d).select("question_id", F.lit("q").alias("question"), F.lit("g").alias("gold"), F.col("sheet").alias("answer"))
    return L.judge(rows, ["truth", "style"], scoring)


@query("select doc_id, least(greatest(doc_id % 9, 1), 6)::integer as level, 2 line_no, 'T' || doc_id title from documents where doc_id % 5 > 0")
def model_headings(spark, d):
    i = F.col("doc_id").cast("string")
    answer = F.concat(F.lit('Here: {"headers": [{"line_no": 2, "level": '), (F.col("doc_id") % 9).cast("string"), F.lit(', "title": "T'), i, F.lit('"}, {"line_no": 99, "level": 1, "title": "no"}]} end'))
    docs = B.table(spark, d, "documents")
    last = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, 3).otherwise(1).alias("last_line"))
    return L.headings_from_json(docs.select("doc_id", answer.alias("answer")), last)


@query("select item_id question_id, unnest([0, 2]) unit_no, unnest(['Unit ' || item_id, 'x']) as text, unnest(['unit ' || item_id, 'x']) normalized from benchmark")
def model_units(spark, d):
    answer = F.concat(F.lit('```json\n{"units": ["Unit '), F.col("item_id").cast("string"), F.lit('", "the Unit '), F.col("item_id").cast("string"), F.lit('", "x", " "]}\n```'))
    return L.target_units(B.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), answer.alias("answer")))


@query(f"with {B.MENTIONS}, g as (select entity_id id, array_agg(chunk_id order by chunk_id) t from m group by entity_id) select id, case when len(t) >= 2 then upper(array_to_string(t[1:5], ' ')) else t[1] end description from g")
def entity_descriptions(spark, d):
    m = G.mentions(B.named(spark, d)).groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list("chunk_id")).alias("texts"))
    return L.descriptions(m, lambda: lambda prompts: [" ".join(p.split("\n")[1:]).upper() for p in prompts])


@query("select o_orderkey id, case when o_custkey % 5 >= 3 then least(64, 2 * (1 + o_orderkey % 60)) else 1 + o_orderkey % 60 end parts from orders")
def escalated_parts(spark, d):
    o = B.table(spark, d, "orders")
    return L.escalated(o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("repeats"), (1 + F.col("o_orderkey") % 60).alias("parts")))
