"""Queries of metrics over runs: traces, evidence, targets and stage logs, and their SQL.

Traces are made of events: a user is a question, views are reads, clicks are searches, purchases are model
calls with tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import traces as R
from corpusloom.plans import base as B
from corpusloom.queries import _SILVER, _hits, query

_TRACE = """trace as (select user_id question_id, row_number() over (partition by user_id order by ts, event_id) pos,
case event_type when 'view' then 'read_file' when 'click' then 'graph_search' when 'error' then 'run_ppr' else 'model' end tool,
case when event_id % 11 <> 0 then 'doc_' || event_id % 40 || '.txt' end file_name, event_id % 9 + 1 start_line, event_id % 9 + 4 end_line, epoch_us(ts) ts,
case when event_type = 'purchase' then event_id % 97 end tokens from events),
steps as (select *, sum(case when tool in ('read_file', 'graph_search') then 1 else 0 end) over (partition by question_id order by pos rows unbounded preceding) step from trace),
rd as (select * from steps where tool = 'read_file' and file_name is not null),
sil as (select user_id question_id, 'doc_' || min(event_id) % 40 || '.txt' file_name, 5 start_line, 7 end_line, 'c' || user_id chunk_id from events where user_id % 3 <> 0 group by user_id)"""


def _trace(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    tool = F.when(F.col("event_type") == "view", "read_file").when(F.col("event_type") == "click", "graph_search").when(F.col("event_type") == "error", "run_ppr").otherwise("model")
    file = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("doc_"), (F.col("event_id") % 40).cast("string"), F.lit(".txt")))
    return e.select(
        F.col("user_id").alias("question_id"), F.expr("row_number() over (partition by user_id order by ts, event_id)").alias("pos"), tool.alias("tool"), file.alias("file_name"),
        (F.col("event_id") % 9 + 1).alias("start_line"), (F.col("event_id") % 9 + 4).alias("end_line"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 97).alias("tokens"),
    )


def _silver(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events").where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("question_id")).agg(F.min("event_id").alias("m"))
    return e.select(
        "question_id", F.concat(F.lit("doc_"), (F.col("m") % 40).cast("string"), F.lit(".txt")).alias("file_name"), F.lit(5).alias("start_line"), F.lit(7).alias("end_line"),
        F.concat(F.lit("c"), F.col("question_id").cast("string")).alias("chunk_id"),
    )


@query(f"with {_TRACE} select question_id, pos, cast(step as bigint) step from steps")
def trace_steps(spark, d):
    return R.steps(_trace(spark, d)).select("question_id", F.col("pos").cast("long").alias("pos"), "step")


@query(
    f"""with {_TRACE}, h as (select r.question_id, min(r.pos) pos from rd r join sil s on s.question_id = r.question_id and s.file_name = r.file_name and r.start_line <= s.end_line and s.start_line <= r.end_line group by all),
hit as (select h.question_id, r.step, r.ts from h join rd r using (question_id, pos)),
tok as (select t.question_id, sum(coalesce(tokens, 0)) total, sum(case when t.ts <= hit.ts then coalesce(tokens, 0) else 0 end) before from trace t left join hit using (question_id) group by all),
dup as (select question_id, 1 - count(distinct (file_name, start_line, end_line)) / count(*) d from rd group by all)
select tok.question_id, case when sil.question_id is not null then (hit.step is not null)::int::double end read_hit, case when sil.question_id is not null then hit.step::double end first_step,
case when sil.question_id is not null then case when hit.step is null then total else before end::double end tokens_to_hit, coalesce(d, 0.0)::double duplicates,
case when sil.question_id is not null then (hit.step is null)::int::double end miss
from tok left join hit using (question_id) left join dup using (question_id) left join sil using (question_id)"""
)
def process_metrics(spark, d):
    return R.process_metrics(_trace(spark, d), _silver(spark, d))


@query(f"with {_TRACE} select question_id, count(*) filter (where tool = 'run_ppr') ppr_calls, case when count(ts) >= 2 then max(ts) - min(ts) end latency from trace group by all")
def trace_costs(spark, d):
    return R.trace_costs(_trace(spark, d))


_EVIDENCE = f"""{_TRACE}, ev as (select question_id, pos, file_name, chunk_id, kind, row_number() over (partition by question_id order by pos) as rank from (
select *, min(no) over (partition by question_id) least_ from (
select question_id, pos, file_name, null as chunk_id, 0 no, 'read' kind from rd where question_id % 4 = 0
union all select question_id, pos, file_name, null, 1, 'citation' from steps where tool = 'graph_search' and question_id % 4 < 2
union all select question_id, pos, null, 'c' || pos, 2, 'chunk' from steps where tool = 'model')) where no = least_)"""


@query(f"with {_EVIDENCE} select question_id, cast(rank as bigint) as rank, kind, file_name, chunk_id from ev")
def evidence_sequence(spark, d):
    t = R.steps(_trace(spark, d)).withColumn("chunk_id", F.lit(None).cast("string"))
    found = R.evidence_sequence(
        t.where("tool = 'read_file' and file_name is not null and question_id % 4 = 0"), t.where("tool = 'graph_search' and question_id % 4 < 2"),
        t.where("tool = 'model'").withColumns({"file_name": F.lit(None).cast("string"), "chunk_id": F.concat(F.lit("c"), F.col("pos").cast("string"))}),
    )
    return found.select("question_id", F.col("rank").cast("long").alias("rank"), "kind", "file_name", "chunk_id")


_NORM = "trim(regexp_replace(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '(^|\\s)(a|an|the)(\\s(a|an|the))*(\\s|$)', ' ', 'g'), '\\s+', ' ', 'g'))"
_UNITS = f"""cu as (select conv_id question_id, turn unit_no, array_to_string(list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '')[1:4], ' ') unit from conversations where role = 'user'),
ct as (select conv_id question_id, {_NORM.format('text')} t from conversations where role = 'assistant')"""


def _units(spark, d):
    c = B.table(spark, d, "conversations").withColumn("n", T.normalize_answer(F.col("text")))
    words = F.filter(F.split("n", " "), lambda w: w != "")
    units = c.where("role = 'user'").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("unit_no"), F.array_join(F.slice(words, 1, 4), " ").alias("unit"))
    return units, c.where("role = 'assistant'").select(F.col("conv_id").alias("question_id"), F.col("n").alias("text"))


def _unit_sql(strict: bool) -> str:
    need = "case when len(list_distinct(string_split(unit, ' '))) <= 2 then 1.0 else 0.75 end" if strict else "0.75"
    return f"""with {_UNITS}, j as (select question_id, unit_no, max((unit <> '' and t is not null and (contains(t, unit)
or len(list_intersect(list_distinct(string_split(unit, ' ')), string_split(t, ' '))) / len(list_distinct(string_split(unit, ' '))) >= {need}))::int) h from cu left join ct using (question_id) group by all)
select question_id, round(avg(coalesce(h, 0)), 9) recall from j group by all"""


@query(_unit_sql(False))
def unit_recall(spark, d):
    return R.unit_recall(*_units(spark, d)).select("question_id", F.round("recall", 9).alias("recall"))


@query(_unit_sql(True))
def unit_recall_strict(spark, d):
    return R.unit_recall(*_units(spark, d), strict_short=True).select("question_id", F.round("recall", 9).alias("recall"))


@query(f"with {B.MENTIONS}, rr as (select distinct doc_id, chunk_id, 1 hit from m where pos = 0 and chunk_id not like '%_c00000'), e as (select distinct doc_id, entity_id, chunk_id from m),"
       " f as (select doc_id, entity_id, coalesce(max(hit), 0) hit from e left join rr using (doc_id, chunk_id) group by all) select doc_id question_id, round(avg(hit), 9) recall from f group by all")
def entity_recall(spark, d):
    from corpusloom.operators import graphs as G

    m = G.mentions(B.named(spark, d)).withColumnRenamed("doc_id", "question_id")
    wanted = m.groupBy("question_id", F.col("entity_id").alias("entity")).agg(F.collect_set("chunk_id").alias("chunk_ids"))
    reached = m.where((F.col("pos") == 0) & ~F.col("chunk_id").endswith("_c00000"))
    return R.entity_recall(wanted, reached).select("question_id", F.round("recall", 9).alias("recall"))


_SUPPORT = f"{_SILVER}, su as (select question_id, list_sort(list(distinct s.chunk_id)) units from hits join silver s using (question_id) where s.chunk_id = silver_id and rank <= 3 group by all)"


@query(f"with {B.CHUNKS}, {_SUPPORT} select question_id, array_to_string(units, '|') units from su")
def supported_units(spark, d):
    hits, silver = _hits(spark, d)
    s = R.supported_units(hits.where("rank <= 3"), silver.withColumn("units", F.array("chunk_id")))
    return s.select("question_id", F.array_join("units", "|").alias("units"))


@query(
    f"""with {B.CHUNKS}, {_SUPPORT}, fa as (select doc_id question_id, chunk_index no, [chunk_id, coalesce(next_chunk_id, chunk_id)] req from c)
select question_id, round(avg((units is not null and list_has_all(units, req))::int), 9) coverage from fa left join su using (question_id) group by all"""
)
def fact_coverage(spark, d):
    hits, silver = _hits(spark, d)
    s = R.supported_units(hits.where("rank <= 3"), silver.withColumn("units", F.array("chunk_id")))
    c = B.chunks(spark, d)
    facts = c.select(F.col("doc_id").alias("question_id"), F.array("chunk_id", F.coalesce("next_chunk_id", "chunk_id")).alias("required"))
    return R.fact_coverage(facts, s).select("question_id", F.round("coverage", 9).alias("coverage"))


@query(
    f"""with {B.CHUNKS}, {_SUPPORT}, cl as (select doc_id question_id, chunk_index no, [chunk_id, coalesce(prev_chunk_id, chunk_id)] u from c)
select question_id, round(avg((units is not null and list_has_any(units, u))::int), 9) coverage from cl left join su using (question_id) group by all"""
)
def claim_coverage(spark, d):
    hits, silver = _hits(spark, d)
    s = R.supported_units(hits.where("rank <= 3"), silver.withColumn("units", F.array("chunk_id")))
    claims = B.chunks(spark, d).select(F.col("doc_id").alias("question_id"), F.array("chunk_id", F.coalesce("prev_chunk_id", "chunk_id")).alias("units"))
    return R.claim_coverage(claims, s).select("question_id", F.round("coverage", 9).alias("coverage"))


@query(
    f"""with {B.CHUNKS}, {_SILVER}, b as (select question_id, silver_id, min(rank) r from hits group by all),
j as (select s.question_id, s.chunk_id, coalesce(r <= 5, false) hit from (select distinct question_id, chunk_id from silver) s left join b on b.question_id = s.question_id and b.silver_id = s.chunk_id)
select question_id, coalesce(string_agg(chunk_id, '|' order by chunk_id) filter (where hit), '') hit_ids, coalesce(string_agg(chunk_id, '|' order by chunk_id) filter (where not hit), '') missed_ids from j group by all"""
)
def hit_lists(spark, d):
    out = R.hit_lists(*_hits(spark, d))
    return out.select("question_id", F.array_join("hit_ids", "|").alias("hit_ids"), F.array_join("missed_ids", "|").alias("missed_ids"))


@query(
    f"""with {B.NAMED}, g as (select doc_id question_id, chunk_id, unnest(names) nm, unnest(range(1, len(names) + 1)) at_ from n), u as (select distinct doc_id question_id, names[1] nm from n where len(names) > 0)
select question_id, chunk_id, array_to_string(list(nm order by at_), '|') matched_units from g semi join u using (question_id, nm) group by all"""
)
def silver_targets(spark, d):
    n = B.named(spark, d)
    units = n.where("size(names) > 0").select(F.col("doc_id").alias("question_id"), F.element_at("names", 1).alias("unit_id")).distinct().withColumn("text", F.col("unit_id"))
    grounded = n.select(F.col("doc_id").alias("question_id"), "chunk_id", F.col("names").alias("unit_ids"))
    return R.silver_targets(units, grounded).select("question_id", "chunk_id", F.array_join("matched_units", "|").alias("matched_units"))


# --- methods and stages -----------------------------------------------------------------------------

_LOG = """lg as (select o_orderpriority stage, case o_orderstatus when 'F' then 'failed' when 'O' then 'ok' end status, o_orderkey run, o_totalprice wall_time_seconds,
o_custkey llm_calls, o_orderkey % 100 input_tokens, o_orderkey % 10 output_tokens, o_custkey * 3 disk_bytes, o_orderkey % 1000 nodes, o_orderkey % 500 edges, o_orderkey % 200 objects, o_orderkey % 7 extra7 from orders)"""


def _log(spark, d):
    o = B.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").alias("status"), k.alias("run"),
        F.col("o_totalprice").alias("wall_time_seconds"), c.alias("llm_calls"), (k % 100).alias("input_tokens"), (k % 10).alias("output_tokens"), (c * 3).alias("disk_bytes"),
        (k % 1000).alias("nodes"), (k % 500).alias("edges"), (k % 200).alias("objects"), F.create_map(F.lit("offline_llm_calls"), (k % 7).cast("double")).alias("extra"),
    )


@query(
    f"""with {_LOG}, x as (select stage, unnest(['wall_time_seconds', 'llm_calls', 'input_tokens', 'output_tokens', 'disk_bytes', 'offline_llm_calls']) metric,
unnest([wall_time_seconds, llm_calls::double, input_tokens::double, output_tokens::double, disk_bytes::double, extra7::double]) v from lg)
select stage, metric, count(*) count, round(sum(v), 2) as sum, median(v) median, quantile_disc(v, 0.9) p90, quantile_disc(v, 0.95) p95, min(v) as min, max(v) as max from x group by all"""
)
def stage_summary(spark, d):
    return R.stage_summary(_log(spark, d)).select("stage", "metric", "count", F.round("sum", 2).alias("sum"), "median", "p90", "p95", "min", "max")


@query(f"with {_LOG} select stage, coalesce(status, 'unknown') status, count(*) runs from lg group by all")
def stage_status(spark, d):
    return R.stage_status(_log(spark, d))


@query(
    f"""with {_LOG} select round(sum(wall_time_seconds), 2) wall_time_seconds, sum(extra7)::double llm_calls, sum(input_tokens)::double input_tokens, sum(output_tokens)::double output_tokens, sum(disk_bytes)::double disk_bytes
from lg where coalesce(status, 'ok') = 'ok' and stage in ('1-URGENT', '5-LOW')"""
)
def offline_costs(spark, d):
    return R.offline_costs(_log(spark, d), ["1-URGENT", "5-LOW"]).withColumn("wall_time_seconds", F.round("wall_time_seconds", 2))


@query(
    f"""with {_LOG}, l as (select stage, max_by(wall_time_seconds, run) w, max_by(disk_bytes, run) b, max_by(nodes, run) n, max_by(edges, run) e, max_by(objects, run) o from lg
where coalesce(status, 'ok') = 'ok' and stage in ('1-URGENT', '2-HIGH', '5-LOW') group by stage)
select round(sum(w), 2) build_seconds, sum(b)::bigint storage_bytes, max(n) nodes, max(e) edges, max(o) objects, round(sum(b) / 1048576, 9) storage_mib, round(max(o) / sum(w), 9) objects_per_second from l where stage <> '2-HIGH'"""
)
def index_efficiency(spark, d):
    out = R.index_efficiency(_log(spark, d), ["1-URGENT", "2-HIGH", "5-LOW"], shared=["2-HIGH"])
    return out.withColumns({"build_seconds": F.round("build_seconds", 2), "storage_mib": F.round("storage_mib", 9), "objects_per_second": F.round("objects_per_second", 9)})


@query(
    f"""with {B.RELATIONS}, x as (select chunk_id, len(names) e, greatest(len(names) - 1, 0) r from n)
select count(*) as rows, count(distinct chunk_id) chunks, count(distinct chunk_id) * 2 calls, sum(e)::bigint entities, sum(r)::bigint relations, round(avg(e), 9) entities_per_chunk, round(avg(r), 9) relations_per_chunk from x"""
)
def extraction_summary(spark, d):
    n = B.named(spark, d).select("chunk_id", F.col("names").alias("entities"), F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0))).alias("relations"))
    return R.extraction_summary(n, gleaning=1).withColumns({c: F.round(c, 9) for c in ("entities_per_chunk", "relations_per_chunk")})


@query(
    "select c_custkey key, case when c_custkey % 4 = 0 then 'new' else 'old' end as src, case when c_custkey % 4 = 0 then c_acctbal + 1 else c_acctbal end as val from customer"
)
def upsert_summaries(spark, d):
    old = B.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("old").alias("src"), F.col("c_acctbal").alias("val"))
    new = old.where("key % 4 = 0").select("key", F.lit("new").alias("src"), (F.col("val") + 1).alias("val"))
    return R.upsert_summaries(old, new, ["key"])


@query("select user_id task, epoch_us(max(ts)) at_us, max_by(event_id, ts) run from events group by all")
def latest_runs(spark, d):
    runs = B.table(spark, d, "events").select(F.col("user_id").alias("task"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("run"))
    return R.latest_runs(runs, at="at_us")


@query(f"with {_TRACE}, r as (select question_id, max(case when tool = 'run_ppr' then 0 else 1 end) ok, max(step) steps, sum(coalesce(tokens, 0)) tokens from steps where pos > 5 group by all)"
       " select count(*) runs, avg(ok) success_rate, round(avg(steps), 9) mean_steps, sum(tokens)::bigint tokens from r")
def fleet_summary(spark, d):
    t = R.steps(_trace(spark, d)).where("pos > 5")
    runs = t.groupBy("question_id").agg(F.max((F.col("tool") != "run_ppr").cast("int")).alias("ok"), F.max("step").alias("steps"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))
    return R.fleet_summary(runs).withColumn("mean_steps", F.round("mean_steps", 9))


@query(
    "select n_name as method, case when n_name in ('FRANCE', 'GERMANY', 'CHINA') then round(avg(c_acctbal), 6) end hit, count(*) n from customer join nation on c_nationkey = n_nationkey group by n_name"
)
def gated_metrics(spark, d):
    c = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.groupBy(F.col("n_name").alias("method")).agg(F.round(F.avg("c_acctbal"), 6).alias("hit"), F.count(F.lit(1)).alias("n"))
    return R.gated(m, ["FRANCE", "GERMANY", "CHINA"], ["hit"])


@query("select l_returnflag dataset, l_linestatus as method, count(*) n, round(avg(l_quantity), 9) mean_score, round(avg((l_quantity >= 7)::int), 9) accuracy from lineitem where l_quantity <> 13 group by all")
def accuracy_table(spark, d):
    s = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), F.when(F.col("l_quantity") != 13, F.col("l_quantity")).alias("score"))
    out = R.accuracy_table(s, ["dataset", "method"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_score", "accuracy")})


@query(
    """select coalesce(case when p_partkey % 2 = 0 then p_brand end, p_name) as method, coalesce(case when p_partkey % 3 = 0 then p_retailprice end, p_size)::double quality,
coalesce(case when p_partkey % 5 = 0 then p_size end, 0)::double online_tokens, 0.0::double online_calls, (p_size + coalesce(case when p_partkey % 7 = 0 then p_size end, 0))::double offline_tokens from part"""
)
def normalized_methods(spark, d):
    p = B.table(spark, d, "part")
    every = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.col(c))
    rows = p.select(
        every(2, "p_brand").alias("method"), F.col("p_name").alias("name"), every(3, "p_retailprice").alias("exact_match"), F.col("p_size").alias("f1"), every(5, "p_size").alias("total_tokens"),
        F.lit(None).cast("double").alias("llm_calls"), F.col("p_size").alias("input_tokens"), every(7, "p_size").alias("output_tokens"),
    )
    return R.normalize_methods(rows)


@query(
    """with p as (select a.conv_id, a.turn, a.text g, b.text p, b.turn gold_no from conversations a join conversations b on b.conv_id = a.conv_id and b.turn in (a.turn + 1, a.turn + 2)),
n as (select conv_id, turn, gold_no, """
    + ", ".join(f"list_filter(string_split({_NORM.format(c)}, ' '), lambda x: x <> '') {c}" for c in ("g", "p"))
    + """ from p),
k as (select conv_id, turn, gold_no, g = p ex, len(g) ng, len(p) np, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(g, lambda x: x = t)), len(list_filter(p, lambda x: x = t))))), 0) c from n),
s as (select *, case when c > 0 then 2 * (c / ng) * (c / np) / (c / ng + c / np) else 0 end f1, max(ex::int::double) over (partition by conv_id, turn) em from k)
select conv_id, turn, round(f1, 9) f1, case when f1 = 0 then 0.0 else round(c / np, 9) end recall, em as exact from s qualify row_number() over (partition by conv_id, turn order by round(f1, 12) desc, gold_no) = 1"""
)
def best_gold(spark, d):
    c = B.table(spark, d, "conversations")
    gold = c.select("conv_id", F.col("turn").alias("gold_no"), F.col("text").alias("gold"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("predicted")).join(gold, "conv_id").where("gold_no in (turn + 1, turn + 2)")
    pairs = pairs.withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    scored = E.token_overlap(pairs, ["key", "conv_id", "turn", "gold_no"]).withColumn("f1", F.round("f1", 12))
    return E.best_gold(scored, "key").select("conv_id", "turn", F.round("f1", 9).alias("f1"), F.round("recall", 9).alias("recall"), "exact")
