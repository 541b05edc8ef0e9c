"""Metrics of runs: traces of tool calls, evidence, silver spans, target units, stage logs.

trace: question_id, pos, tool, file_name, start_line, end_line, ts, tokens.  silver: question_id, chunk_id,
file_name, start_line, end_line.  Everything is per question, so questions are the partitioning and
a question's rows meet in windows and grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def steps(trace: DataFrame) -> DataFrame:
    """Adds step: how many searches and reads have begun, this call included."""
    counts = F.col("tool").contains("search") | (F.col("tool") == "read_file")
    order = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return trace.withColumn("step", F.sum(F.when(F.coalesce(counts, F.lit(False)), 1).otherwise(0)).over(order))


def reads(trace: DataFrame) -> DataFrame:
    """Read calls of a known file, with their step."""
    return steps(trace).where((F.col("tool") == "read_file") & (F.coalesce("file_name", F.lit("")) != ""))


def evidence_sequence(read: DataFrame, cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A question's reads; without reads its citations; without both its retrieved chunks.

    Each has question_id, pos, file_name, start_line, end_line, chunk_id.  Adds kind and rank.
    """
    rows = None
    for no, (kind, part) in enumerate((("read", read), ("citation", cited), ("chunk", retrieved))):
        part = part.select("question_id", "pos", "file_name", "start_line", "end_line", "chunk_id", F.lit(no).alias("_no"), F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    mine = Window.partitionBy("question_id")
    rows = rows.withColumn("_least", F.min("_no").over(mine)).where("_no = _least")
    return rows.withColumn("rank", F.row_number().over(mine.orderBy("pos"))).drop("_no", "_least")


def duplicate_ratio(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """question_id, duplicates: 1 - distinct / all."""
    return items.groupBy("question_id").agg((1 - F.countDistinct(F.struct(*key)) / F.count(F.lit(1))).alias("duplicates"))


def process_metrics(trace: DataFrame, silver: DataFrame) -> DataFrame:
    """question_id, read_hit, first_step, tokens_to_hit, duplicates, miss for every question of the trace.

    Without silver all but duplicates are null.  Tokens to the first hit are those of calls no later than
    it; without a hit, all of them; null if the hit has no time.
    """
    read = reads(trace)
    spans = silver.select("question_id", F.col("file_name").alias("f"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    same = (F.col("file_name") == F.col("f")) & T.overlap(F.col("start_line"), F.col("end_line"), F.col("s"), F.col("e"))
    first = read.join(spans, "question_id").where(same).groupBy("question_id").agg(F.min(F.struct("pos", "step", "ts")).alias("hit"))
    asked = silver.select("question_id", F.lit(True).alias("known")).distinct()
    rows = trace.join(first, "question_id", "left")
    before = F.when(F.col("ts") <= F.col("hit.ts"), F.col("tokens")).otherwise(0)
    sums = rows.groupBy("question_id").agg(F.first("hit").alias("hit"), F.sum(F.coalesce(before, F.lit(0))).alias("before"), F.sum(F.coalesce("tokens", F.lit(0))).alias("total"))
    out = sums.join(duplicate_ratio(read, ["file_name", "start_line", "end_line"]), "question_id", "left").join(asked, "question_id", "left")
    hit = F.col("hit").isNotNull()
    known = lambda c: F.when(F.col("known"), c)
    return out.select(
        "question_id",
        known(hit.cast("double")).alias("read_hit"),
        known(F.col("hit.step").cast("double")).alias("first_step"),
        known(F.when(~hit, F.col("total")).when(F.col("hit.ts").isNotNull(), F.col("before")).cast("double")).alias("tokens_to_hit"),
        F.coalesce("duplicates", F.lit(0.0)).alias("duplicates"),
        known((~hit).cast("double")).alias("miss"),
    )


def trace_costs(trace: DataFrame) -> DataFrame:
    """question_id, ppr_calls, latency (null with fewer than two times)."""
    return trace.groupBy("question_id").agg(
        F.count_if(F.lower(F.to_json(F.struct("tool", "file_name"))).contains("ppr")).alias("ppr_calls"),
        F.when(F.count("ts") >= 2, F.max("ts") - F.min("ts")).alias("latency"),
    )


# --- target units, entities and claims ------------------------------------------------------------


def unit_recall(units: DataFrame, texts: DataFrame, *, strict_short: bool = False) -> DataFrame:
    """question_id, recall: share of a question's units that one of its texts holds.

    units: question_id, unit (normalised); texts: question_id, text (normalised).
    """
    held = T.unit_in_text(F.col("unit"), F.col("text"), strict_short=strict_short)
    found = units.join(texts, "question_id", "left").groupBy("question_id", "unit_no").agg(F.max(F.coalesce(held, F.lit(False)).cast("int")).alias("held"))
    return found.groupBy("question_id").agg(F.avg("held").alias("recall"))


def entity_recall(entities: DataFrame, reached: DataFrame) -> DataFrame:
    """question_id, recall: share of target entities with a chunk among those reached.

    entities: question_id, entity, chunk_ids; reached: question_id, chunk_id.
    """
    wanted = entities.select("question_id", "entity", F.explode_outer("chunk_ids").alias("chunk_id"))
    seen = reached.select("question_id", "chunk_id", F.lit(1).alias("hit")).distinct()
    found = wanted.join(seen, ["question_id", "chunk_id"], "left").groupBy("question_id", "entity").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return found.groupBy("question_id").agg(F.avg("hit").alias("recall"))


def supported_units(hits: DataFrame, silver: DataFrame) -> DataFrame:
    """question_id, units: the union of the units that the silver chunks hit support."""
    rows = hits.select("question_id", "silver_id").distinct().join(silver.select("question_id", F.col("chunk_id").alias("silver_id"), "units"), ["question_id", "silver_id"])
    return rows.select("question_id", F.explode("units").alias("u")).groupBy("question_id").agg(F.array_sort(F.collect_set("u")).alias("units"))


def is_covered(required: Column, supported: Column) -> Column:
    """A fact with requirements, all of them supported."""
    return (F.size(required) > 0) & (F.size(F.array_except(required, F.coalesce(supported, F.array().cast("array<string>")))) == 0)


def fact_coverage(facts: DataFrame, supported: DataFrame) -> DataFrame:
    """question_id, coverage: share of facts (question_id, required) that are covered."""
    rows = facts.join(supported, "question_id", "left")
    return rows.groupBy("question_id").agg(F.avg(is_covered(F.col("required"), F.col("units")).cast("int")).alias("coverage"))


def claim_coverage(claims: DataFrame, matched: DataFrame) -> DataFrame:
    """question_id, coverage: share of claims with a unit that a silver chunk hit matches, or that stands
    in one.  claims: question_id, claim_no, units; matched: question_id, units."""
    rows = claims.join(matched.withColumnRenamed("units", "held"), "question_id", "left")
    rows = rows.withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    hit = F.arrays_overlap("units", "held") | F.exists("units", lambda u: F.exists("held", lambda h: T.unit_in_text(u, h)))
    return rows.groupBy("question_id").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("coverage"))


def hit_lists(hits: DataFrame, silver: DataFrame, k: int = 5) -> DataFrame:
    """question_id, hit_ids, missed_ids among the first k items, sorted."""
    best = hits.groupBy("question_id", "silver_id").agg(F.min("rank").alias("rank"))
    rows = silver.select("question_id", F.col("chunk_id").alias("silver_id")).distinct().join(best, ["question_id", "silver_id"], "left")
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return rows.groupBy("question_id").agg(
        F.array_sort(F.collect_set(F.when(hit, F.col("silver_id")))).alias("hit_ids"), F.array_sort(F.collect_set(F.when(~hit, F.col("silver_id")))).alias("missed_ids")
    )


def silver_targets(units: DataFrame, grounded: DataFrame) -> DataFrame:
    """question_id, chunk_id, matched_units: units of a question found in a chunk, unknown ids left out.

    units: question_id, unit_id, text; grounded: question_id, chunk_id, unit_ids.
    """
    rows = grounded.select("question_id", "chunk_id", F.posexplode("unit_ids").alias("at", "unit_id")).join(units, ["question_id", "unit_id"])
    held = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r["text"])
    return rows.groupBy("question_id", "chunk_id").agg(F.array_distinct(held).alias("matched_units"))


def gated(metrics: DataFrame, methods: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Evidence metrics only for methods that cite evidence; null for others."""
    return metrics.withColumns({c: F.when(F.col("method").isin(*methods), F.col(c)) for c in columns})


def accuracy_table(scores: DataFrame, by: Sequence[str], *, threshold: float = 7.0) -> DataFrame:
    """n, mean score and accuracy (share of scores at the threshold and above) per group; no score is none."""
    return scores.where("score is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("score") >= threshold).cast("int")).alias("accuracy")
    )


def normalize_methods(rows: DataFrame) -> DataFrame:
    """Quality is exact match, else F1; costs fall back from means to zero; names from method to name."""
    zero = lambda *cs: F.coalesce(*[F.col(c).cast("double") for c in cs], F.lit(0.0))
    return rows.select(
        F.coalesce("method", "name").alias("method"), zero("exact_match", "f1").alias("quality"), zero("total_tokens").alias("online_tokens"),
        zero("llm_calls").alias("online_calls"), (zero("input_tokens") + zero("output_tokens")).alias("offline_tokens"),
    )


# --- stage logs -------------------------------------------------------------------------------------

STAGE_FIELDS = ("wall_time_seconds", "llm_calls", "input_tokens", "output_tokens", "disk_bytes")


def selected_stages(log: DataFrame, stages: Sequence[str] = ()) -> DataFrame:
    """Rows of status ok (or none) in the stages named; none named are all."""
    ok = log.where(F.coalesce("status", F.lit("ok")) == "ok")
    return ok.where(F.col("stage").isin(*stages)) if stages else ok


def stage_summary(log: DataFrame, fields: Sequence[str] = STAGE_FIELDS) -> DataFrame:
    """stage, metric, count, sum, mean, median, p90, p95, min, max over fields and extra metrics.

    log: stage, status, the fields, extra map<string, double>.
    """
    from corpusloom.operators.evaluation import value_summary

    own = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))])
    rows = log.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    long = rows.select("stage", F.explode(own).alias("metric", "value"))
    if "extra" in log.columns:
        long = long.unionByName(rows.select("stage", F.explode("extra").alias("metric", "value")))
    return value_summary(long, ["stage", "metric"], F.col("value"))


def stage_status(log: DataFrame) -> DataFrame:
    """stage, status, runs."""
    names = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("stage", "status")]
    return log.select(*names).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("runs"))


def offline_costs(log: DataFrame, stages: Sequence[str] = (), fields: Sequence[str] = STAGE_FIELDS) -> DataFrame:
    """One row: sums over selected stages; an extra metric named offline_<field> replaces the field."""
    rows = selected_stages(log, stages)
    value = lambda f: F.coalesce(F.col("extra").getItem(f"offline_{f}"), F.col(f).cast("double"), F.lit(0.0))
    return rows.agg(*[F.coalesce(F.sum(value(f)), F.lit(0.0)).alias(f) for f in fields])


def extraction_summary(rows: DataFrame, *, gleaning: int = 0) -> DataFrame:
    """One row: chunks, model calls, entities and relations before merging.  rows: chunk_id, entities, relations."""
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("chunk_id").alias("chunks"), (F.countDistinct("chunk_id") * (1 + gleaning)).alias("calls"),
        F.sum(size("entities")).alias("entities"), F.sum(size("relations")).alias("relations"),
        F.avg(size("entities")).alias("entities_per_chunk"), F.avg(size("relations")).alias("relations_per_chunk"),
    )


def index_efficiency(log: DataFrame, build: Sequence[str], *, shared: Sequence[str] = ()) -> DataFrame:
    """One row: build seconds and bytes of the method's own stages (the latest good run of each), nodes,
    edges, objects and objects a second.  Shared annotation stages are left out of the build."""
    latest = selected_stages(log, build).groupBy("stage").agg(*[F.max_by(c, "run").alias(c) for c in ("wall_time_seconds", "disk_bytes", "nodes", "edges", "objects")])
    own = latest.where(~F.col("stage").isin(*shared)) if shared else latest
    sums = own.agg(F.sum("wall_time_seconds").alias("build_seconds"), F.sum("disk_bytes").alias("storage_bytes"), F.max("nodes").alias("nodes"), F.max("edges").alias("edges"), F.max("objects").alias("objects"))
    return sums.withColumns({"storage_mib": F.col("storage_bytes") / 1048576, "objects_per_second": F.try_divide("objects", "build_seconds")})


def upsert_summaries(old: DataFrame, new: DataFrame, key: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def latest_runs(runs: DataFrame, task: str = "task", at: str = "at") -> DataFrame:
    """The newest run of each task."""
    others = [c for c in runs.columns if c not in (task, at)]
    return runs.groupBy(task).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in others])


def fleet_summary(runs: DataFrame) -> DataFrame:
    """One row over runs (ok, steps, tokens): runs, success rate, mean steps and tokens."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.avg("steps").alias("mean_steps"), F.sum("tokens").alias("tokens")
    )
