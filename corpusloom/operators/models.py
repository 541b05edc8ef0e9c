"""Language and reranking models at the edge of plans: prompts go in, answers come out, the rest is tables.

A model is a function made once per partition, ``provider() -> (list of prompts -> list of answers)``, so
any client or a deterministic stand-in fits.  Answers are kept by a key of model and prompt, which
makes reruns and retried tasks cheap and identical.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import top_k
from corpusloom.operators.search import json_object

Provider = Callable[[], Callable[[list[str]], list[str]]]
#: Fixed value: what is answered where no evidence was found.
NO_EVIDENCE = "Insufficient evidence."


def ask(rows: DataFrame, provider: Provider, *, batch: int = 16, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds answer to rows with id and prompt.  A failing batch is tried again; then its prompts alone, and
    what fails alone gets error and no answer."""

    def tried(model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        reason = ""
        for left in range(retries, -1, -1):
            try:
                return [(a, None) for a in model(prompts)]
            except Exception as e:  # a model's failures are data: the row says which
                reason = f"{type(e).__name__}: {e}"
                if left and wait:
                    time.sleep(wait)
        if len(prompts) == 1:
            return [(None, reason)]
        return [x for p in prompts for x in tried(model, [p])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for b in batches:
            out = [x for i in range(0, len(b), batch) for x in tried(model, b["prompt"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame([(i, *x) for i, x in zip(b["id"], out, strict=True)], columns=["id", "answer", "error"])

    return rows.select("id", "prompt").mapInPandas(run, "id string, answer string, error string")


def cache_key(model: str, prompt: Column) -> Column:
    return F.concat(F.lit("answer:"), F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256))


def cached(rows: DataFrame, cache: DataFrame, model: str, provider: Provider, **how) -> tuple[DataFrame, DataFrame]:
    """Answers of rows (id, prompt), and the cache rows (key, answer) to add.

    A prompt is asked once however many rows have it; failed answers are not kept.
    """
    keyed = rows.withColumn("key", cache_key(model, F.col("prompt")))
    new = keyed.join(cache.select("key"), "key", "left_anti").groupBy(F.col("key").alias("id")).agg(F.min("prompt").alias("prompt"))
    made = ask(new, provider, **how).where("error is null").select(F.col("id").alias("key"), "answer")
    every = cache.select("key", "answer").unionByName(made)
    return keyed.join(every, "key", "left").select("id", "answer"), made


# --- prompts and what is read back --------------------------------------------------------------------


def judge_prompts(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """id, dimension, prompt: each answer against the gold one, once per dimension; scores from 0 to 10."""
    text = F.concat_ws(
        "\n", F.concat(F.lit("Judge the "), "dimension", F.lit(" of an answer from 0 to 10 as <score>n</score>.")), F.concat(F.lit("Question: "), "question"),
        F.concat(F.lit("Gold: "), "gold"), F.concat(F.lit("Answer: "), "answer"),
    )
    each = rows.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    return each.select(F.concat_ws("|", "question_id", "dimension").alias("id"), "question_id", "dimension", text.alias("prompt"))


def judge(rows: DataFrame, dimensions: Sequence[str], provider: Provider) -> DataFrame:
    """question_id and a score (0 to 1) per dimension; null where the judge gave none."""
    prompts = judge_prompts(rows, dimensions)
    said = prompts.join(ask(prompts, provider), "id").withColumn("score", T.judge_score(F.col("answer")))
    return said.groupBy("question_id").pivot("dimension", list(dimensions)).agg(F.max("score"))


def headings_from_json(rows: DataFrame, last_line: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title of a model's JSON answer ({"headers": [...]}): levels 1 to 6, known
    lines, the first of each line.  rows: doc_id, answer; last_line: doc_id, last_line."""
    schema = "struct<headers:array<struct<line_no:int,level:int,title:string>>>"
    found = rows.select("doc_id", F.inline(F.from_json(json_object(F.col("answer")), schema)["headers"]))
    found = found.join(last_line, "doc_id").where("line_no between 1 and last_line and trim(title) <> ''")
    found = found.withColumn("level", F.least(F.greatest("level", F.lit(1)), F.lit(6)))
    return found.groupBy("doc_id", "line_no").agg(F.min_by("level", F.struct("level", "title")).alias("level"), F.min_by("title", F.struct("level", "title")).alias("title"))


def descriptions(rows: DataFrame, provider: Provider, *, least: int = 2, most: int = 5) -> DataFrame:
    """id, description: objects described in several chunks get one text of a model, others keep their own.

    rows: id, texts (in order).  The first ``most`` texts make the prompt.
    """
    many = rows.where(F.size("texts") >= least).select("id", F.concat(F.lit("Describe in one sentence:\n"), F.array_join(F.slice("texts", 1, most), "\n")).alias("prompt"))
    said = ask(many, provider).select("id", "answer")
    return rows.join(said, "id", "left").select("id", F.coalesce("answer", F.element_at("texts", 1)).alias("description"))


def target_units(rows: DataFrame) -> DataFrame:
    """question_id, unit_no, text, normalized: a model's JSON list of units, blank and repeated ones left out."""
    units = F.from_json(json_object(F.col("answer")), "struct<units:array<string>>")["units"]
    each = rows.select("question_id", F.posexplode(units).alias("unit_no", "text")).withColumn("normalized", T.normalize_answer(F.col("text"))).where("normalized <> ''")
    first = each.groupBy("question_id", "normalized").agg(F.min_by(F.struct("unit_no", "text"), "unit_no").alias("u"))
    return first.select("question_id", "u.unit_no", "u.text", "normalized")


def rounds(questions: DataFrame, search: Callable[[DataFrame], DataFrame], provider: Provider, *, stored: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Agents that search and read until they answer: question_id, answer, rounds, n_evidence, and their trace.

    The trace has a row per question and round: question_id, round, said, query (what was searched next, null at the
    end), n_evidence (before the round).  ``stored`` keeps what models said, so no later action asks them again.
    A model sees the question and the evidence so far and says a search or an <answer>.  An answer before
    any evidence is dropped and the question itself is searched; no evidence at the end is NO_EVIDENCE.
    questions: question_id (string), text; search takes (question_id, query) and gives (question_id, chunk).
    """
    from corpusloom.operators.search import last_search

    open_ = stored(questions.select(F.col("question_id").cast("string").alias("question_id"), "text"))
    spark = open_.sparkSession
    evidence = spark.createDataFrame([], "question_id string, chunk string")
    done = spark.createDataFrame([], "question_id string, answer string, rounds int")
    trace = None
    for turn in range(1, most + 1):
        known = evidence.groupBy("question_id").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"))
        state = open_.join(known, "question_id", "left")
        prompt = F.concat_ws("\n", F.concat(F.lit("Question: "), "text"), F.coalesce(F.array_join("chunks", "\n"), F.lit("")), F.lit("Say <search>...</search> or <answer>...</answer>."))
        said = stored(state.join(ask(state.select(F.col("question_id").alias("id"), prompt.alias("prompt")), provider).withColumnRenamed("id", "question_id"), "question_id", "left"))
        answer = F.regexp_extract("answer", r"(?is)<answer>(.*?)</answer>", 1)
        ready = F.col("answer").rlike(r"(?is)<answer>.*?</answer>") & F.col("chunks").isNotNull()
        ready = F.coalesce(ready | (F.lit(turn == most) & F.col("chunks").isNotNull()), F.lit(False))
        done = done.unionByName(said.where(ready).select("question_id", F.trim(F.when(answer != "", answer).otherwise(F.lit(NO_EVIDENCE))).alias("answer"), F.lit(turn).alias("rounds")))
        open_ = stored(said.where(~ready).select("question_id", "text"))
        wanted = F.when(last_search(F.coalesce("answer", F.lit(""))) != "", last_search(F.col("answer"))).otherwise(F.col("text"))
        seen = F.coalesce(F.size("chunks"), F.lit(0)).alias("n_evidence")
        step = said.select("question_id", F.lit(turn).alias("round"), F.col("answer").alias("said"), F.when(~ready & F.lit(turn < most), wanted).alias("query"), seen)
        trace = step if trace is None else trace.unionByName(step)
        evidence = stored(evidence.unionByName(search(said.where(~ready).select("question_id", wanted.alias("query")))))
        if open_.isEmpty():
            break
    rest = open_.select("question_id", F.lit(NO_EVIDENCE).alias("answer"), F.lit(most).alias("rounds"))
    n = evidence.groupBy("question_id").agg(F.countDistinct("chunk").alias("n"))
    answers = done.unionByName(rest).join(n, "question_id", "left").select("question_id", "answer", "rounds", F.coalesce("n", F.lit(0)).alias("n_evidence"))
    return answers, trace


def run_batch(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], provider: Provider, folder: str, *, stored: Callable[[DataFrame], DataFrame], most: int = 3
) -> DataFrame:
    """The answers of all questions, kept in a folder with the traces; questions that have one there are not asked again.

    A run writes its traces, then its answers, so that one that was cut off asks its questions once more and repeats no answer.
    """
    spark = questions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/answers")
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if known:
        have = spark.read.parquet(f"{folder}/answers").select("question_id")
        questions = questions.join(have, questions["question_id"].cast("string") == have["question_id"], "left_anti")
    questions = stored(questions)
    if not known or not questions.isEmpty():
        answers, trace = rounds(questions, search, provider, most=most, stored=stored)
        answers = stored(answers)
        trace.write.mode("append").parquet(f"{folder}/traces")
        answers.write.mode("append").parquet(f"{folder}/answers")
    return spark.read.parquet(f"{folder}/answers")


def answered(questions: DataFrame, evidence: DataFrame, provider: Provider, *, k: int = 5) -> DataFrame:
    """question_id, answer in one round: the question with its k best chunks, or alone (closed book).

    evidence: query_id, id, rank, content; without rows the prompt holds the question only.
    """
    best = evidence.where(F.col("rank") <= k).groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("e"))
    rows = questions.join(best, "question_id", "left")
    body = F.array_join(F.transform(F.coalesce("e", F.array().cast("array<struct<rank:int,content:string>>")), lambda x: x["content"]), "\n")
    prompt = F.concat_ws("\n", F.when(body != "", body), F.concat(F.lit("Question: "), "text"))
    said = ask(rows.select(F.col("question_id").cast("string").alias("id"), prompt.alias("prompt")), provider)
    return said.select(F.col("id").alias("question_id"), T.extract_answer(F.col("answer")).alias("answer"))


def neighbours(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All graph objects as texts, ranked by keywords whatever their type.  texts: id, text."""
    from corpusloom.operators.retrieval import keyword_top_k

    return keyword_top_k(texts, queries, k)


def escalated(failures: DataFrame, *, threshold: int = 3, most: int = 64) -> DataFrame:
    """id, parts: objects that failed ``threshold`` times in a row are cut in twice as many parts, up to a cap.

    failures: id, repeats, parts.
    """
    more = F.least(F.col("parts") * 2, F.lit(most))
    return failures.select("id", F.when(F.col("repeats") >= threshold, more).otherwise(F.col("parts")).alias("parts"))


def best_batches(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, k)


@contextmanager
def timed_stage(spark: SparkSession, path: str, stage: str, **more):
    """Appends a row (stage, status, wall_time_seconds, ...) to the stage log at ``path``, failures too."""
    began, status = time.time(), "ok"
    try:
        yield
    except BaseException:
        status = "failed"
        raise
    finally:
        row = {"stage": stage, "status": status, "wall_time_seconds": time.time() - began, **{k: str(v) for k, v in more.items()}}
        spark.createDataFrame([row]).write.mode("append").json(path)
