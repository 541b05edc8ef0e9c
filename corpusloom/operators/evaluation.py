"""Answer overlap, evidence metrics, costs, statistics and validators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from corpusloom.functions import text as T


def token_overlap(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Adds precision, recall, f1, exact and contains of normalised predicted against gold.

    The multiset overlap is counted inside a row: tokens are few, so no explode and no shuffle.
    """
    g, p = T.normalize_answer(F.col("gold")), T.normalize_answer(F.col("predicted"))
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    df = pairs.withColumns({"_g": words(g), "_p": words(p), "_gs": g, "_ps": p})
    count = lambda arr, t: F.size(F.filter(F.col(arr), lambda x: x == t))
    common = F.aggregate(F.array_distinct("_g"), F.lit(0), lambda a, t: a + F.least(count("_g", t), count("_p", t)))
    df = df.withColumn("_c", common)
    pr = F.when(F.size("_p") > 0, F.col("_c") / F.size("_p")).otherwise(0.0)
    rc = F.when(F.size("_g") > 0, F.col("_c") / F.size("_g")).otherwise(0.0)
    df = df.withColumns({"precision": pr, "recall": rc})
    f1 = F.when(F.col("_c") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    out = df.withColumns(
        {"f1": f1, "exact": (F.col("_gs") == F.col("_ps")).cast("double"), "contains": F.when(F.col("_gs") == "", 0.0).otherwise(F.col("_ps").contains(F.col("_gs")).cast("double"))}
    )
    return out.select(*key, "precision", "recall", "f1", "exact", "contains")


def best_gold(scored: DataFrame, key: str) -> DataFrame:
    """The gold answer with the strictly largest F1 (the first among equals; all zeros if it is 0)."""
    w = Window.partitionBy(key).orderBy(F.desc("f1"), "gold_no")
    best = scored.withColumn("exact", F.max("exact").over(Window.partitionBy(key))).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    zero = F.col("f1") == 0
    return best.withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in ("precision", "recall")}).drop("_r", "gold_no")


def value_summary(values: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """count, sum, mean, median, nearest-rank p90 and p95, min, max; nulls are no values."""
    ordered = lambda q: F.expr(f"percentile_disc({q}) within group (order by _v)")
    v = values.withColumn("_v", value).where("_v is not null")
    return v.groupBy(*by).agg(
        F.count("_v").alias("count"), F.sum("_v").alias("sum"), F.avg("_v").alias("mean"), F.percentile("_v", 0.5).alias("median"),
        ordered(0.9).alias("p90"), ordered(0.95).alias("p95"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    )


def span_hits(evidence: DataFrame, silver: DataFrame) -> DataFrame:
    """question_id, rank, silver_id: evidence spans that overlap silver spans of the file, or equal ids."""
    joined = evidence.alias("e").join(silver.alias("s"), "question_id")
    same = F.coalesce(F.col("e.chunk_id") == F.col("s.chunk_id"), F.lit(False))
    near = (F.col("e.file_name") == F.col("s.file_name")) & T.overlap(F.col("e.start_line"), F.col("e.end_line"), F.col("s.start_line"), F.col("s.end_line"))
    return joined.where(same | near).select("question_id", F.col("e.rank").alias("rank"), F.col("s.chunk_id").alias("silver_id")).distinct()


def silver_metrics(hits: DataFrame, silver: DataFrame, k: int = 5) -> DataFrame:
    """hit@k, recall@k and reciprocal rank of the whole sequence; questions without silver are absent."""
    total = silver.groupBy("question_id").agg(F.countDistinct("chunk_id").alias("n"))
    got = hits.groupBy("question_id").agg(
        F.countDistinct(F.when(F.col("rank") <= k, F.col("silver_id"))).alias("h"), F.min("rank").alias("first")
    )
    out = total.join(got, "question_id", "left")
    h = F.coalesce("h", F.lit(0))
    return out.select("question_id", (h > 0).cast("double").alias("hit"), (h / F.col("n")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def pareto(methods: DataFrame) -> DataFrame:
    """Methods no other beats on quality and tokens both."""
    o = methods.select(F.col("quality").alias("q"), F.col("tokens").alias("t"), F.col("method").alias("m"))
    worse = (F.col("q") >= F.col("quality")) & (F.col("t") <= F.col("tokens")) & ((F.col("q") > F.col("quality")) | (F.col("t") < F.col("tokens")))
    return methods.join(o, worse & (F.col("m") != F.col("method")), "left_anti")


def amortized(methods: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Offline cost spread over a workload plus online cost, for each size."""
    return methods.select("method", F.explode(F.array(*map(F.lit, sizes))).alias("queries"), "offline", "online").select(
        "method", "queries", (F.col("offline") / F.col("queries") + F.col("online")).alias("cost")
    )


def break_even(pairs: DataFrame) -> DataFrame:
    """Queries after which a method's dearer index is paid back; null without a saving."""
    saved = F.col("base_online") - F.col("online")
    need = F.greatest(F.col("offline") - F.col("base_offline"), F.lit(0.0)) / saved
    return pairs.withColumn("break_even", F.when(saved > 0, F.ceil(need)))


#: Resamples whose sums travel as one row.
_CHUNK = 500


def _resampled(values: DataFrame, by: str, n_boot: int, seed: int) -> DataFrame:
    """by, n, mean, means: the values' number, their mean, and the sorted means of all resamples.

    Every value comes into every resample as often as a Poisson number of mean one says, so resamples are sums, taken in
    one pass: equal values of a group are one row with a count, whose number is drawn at once; a task adds up a row of sums per
    group; tasks' sums meet per group and chunk of resamples.  No task holds a group's values.  Numbers are seeded by group and
    value, so reruns agree.  A resample without any value has the group's mean.
    """
    rows = values.select(by, F.col("value").cast("double").alias("value"))
    counted = rows.where(F.col("value").isNotNull()).groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("seed", F.xxhash64(by, "value", F.lit(seed)))
    chunks = -(-n_boot // _CHUNK)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            keys = pa.array([k for k in held for _ in range(chunks)], kind)
            parts = [[x[i * _CHUNK : (i + 1) * _CHUNK].tobytes() for x in two] + [i] for two in held.values() for i in range(chunks)]
            held.clear()
            return pa.RecordBatch.from_arrays([keys, pa.array([p[2] for p in parts], pa.int64()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=[by, "chunk", "w", "s"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value, n, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key not in held:
                    if len(held) >= 128:
                        yield flush()
                    held[key] = np.zeros(n_boot), np.zeros(n_boot)
                drawn = np.random.Generator(np.random.PCG64(start % (1 << 64))).poisson(n, n_boot)
                held[key][0][:] += drawn
                held[key][1][:] += drawn * value
        if held:
            yield flush()

    def mean(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t["w"].to_pylist(), t["s"].to_pylist(), strict=True))  # the same sum in every run
        w, s = (sum(np.frombuffer(p[i]) for p in parts) for i in (0, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            means = pa.array(s / w, mask=w == 0)
        return pa.Table.from_arrays([t[by].combine_chunks()[:1], pa.ListArray.from_arrays(pa.array([0, len(w)], pa.int32()), means)], [by, "part"])

    own = values.schema[by]
    sums = counted.mapInArrow(add, TY.StructType([own, TY.StructField("chunk", TY.LongType()), TY.StructField("w", TY.BinaryType()), TY.StructField("s", TY.BinaryType())]))
    parts = sums.groupBy(by, "chunk").applyInArrow(mean, TY.StructType([own, TY.StructField("part", TY.ArrayType(TY.DoubleType()))]))
    plain = rows.groupBy(by).agg(F.count("value").alias("n"), F.sum("value").alias("sum"))
    both = plain.unionByName(parts, allowMissingColumns=True)
    both = both.groupBy(by).agg(F.max("n").alias("n"), F.coalesce(F.max("sum") / F.nullif(F.max("n"), F.lit(0)), F.lit(0.0)).alias("mean"), F.flatten(F.collect_list("part")).alias("means"))
    return both.withColumn("means", F.array_sort(F.transform("means", lambda m: F.coalesce(m, F.col("mean")))))


def _edges(n_boot: int, alpha: float) -> tuple[Column, Column]:
    low, high = max(1, math.ceil(n_boot * alpha / 2)), min(n_boot, int(n_boot * (1 - alpha / 2)))
    return tuple(F.coalesce(F.try_element_at("means", F.lit(i)), F.lit(0.0)) for i in (low, high))


def bootstrap(values: DataFrame, by: str, *, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 20240101) -> DataFrame:
    """Mean and percentile interval per group; no values give zeros, one value a point."""
    low, high = _edges(n_boot, alpha)
    return _resampled(values, by, n_boot, seed).select(by, "n", "mean", low.alias("low"), high.alias("high"))


def paired_bootstrap(pairs: DataFrame, by: str, *, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 20240101) -> DataFrame:
    """Difference of means with interval, and the share of resamples as far from it as it is from 0 (1 without pairs)."""
    low, high = _edges(n_boot, alpha)
    far = F.size(F.filter("means", lambda m: F.abs(m - F.col("mean")) >= F.abs("mean"))) / F.lit(float(n_boot))
    rows = _resampled(pairs.select(by, (F.col("a") - F.col("b")).alias("value")), by, n_boot, seed)
    return rows.select(by, "n", F.col("mean").alias("diff"), low.alias("low"), high.alias("high"), F.when(F.col("n") > 0, far).otherwise(1.0).alias("p"))


# --- validators: a violation is a row ------------------------------------------------------------


def missing(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    bad = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(bad).alias("field")).select("key", F.concat(F.lit("missing "), "field").alias("issue"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("duplicate id").alias("issue"))


def line_order(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    bad = lines.withColumn("before", F.lag("line_no").over(w)).where("line_no <= before")
    return bad.select(F.col("doc_id").cast("string").alias("key"), F.lit("line numbers fall").alias("issue")).distinct()


def broken_links(chunks: DataFrame) -> DataFrame:
    ids = chunks.select(F.col("chunk_id").alias("to"))
    links = chunks.select("chunk_id", F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("to")).where("to is not null")
    return links.join(ids, "to", "left_anti").select(F.col("chunk_id").alias("key"), F.lit("link to nowhere").alias("issue"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.col("node_id").alias("key"), F.lit("edge without node").alias("issue"))
