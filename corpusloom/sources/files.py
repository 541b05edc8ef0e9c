"""Readers and writers of corpora, questions and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as X

#: Keys that hold a record's text, in the order they are tried.
TEXT_KEYS = ("text", "content", "context", "document", "passage")
ID_KEYS = ("question_id", "id", "qid")


def read_jsonl(spark: SparkSession, path: str, schema: X.StructType | str, *, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """JSON lines.  Strict reading fails on the first bad line; otherwise bad lines come as ``_bad``."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = schema if isinstance(schema, X.StructType) else X.StructType.fromDDL(schema)
    return spark.read.schema(kind.add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system the path names, so any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns how many, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text of whole text and Markdown files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))


def text_of_json(json: Column) -> Column:
    """The first text key that is not blank, else the JSON itself."""
    tries = [F.get_json_object(json, f"$.{k}") for k in TEXT_KEYS]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in tries], json)


def text_of_jsonl(lines: DataFrame, key: str, pos: str, json: str) -> DataFrame:
    """Texts of a file's lines joined by a blank line."""
    parts = F.sort_array(F.collect_list(F.struct(pos, text_of_json(F.col(json)).alias("t"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def prepare_corpus(rows: DataFrame) -> DataFrame:
    """Long documents: the first row of each context, with a safe file name of at most 80 characters.

    rows: pos, context_id, title, context.
    """
    w = Window.partitionBy("context_id").orderBy("pos")
    first = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    name = F.substring(F.regexp_replace(F.coalesce("title", "context_id"), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return first.select(F.col("context_id").alias("doc_id"), F.concat(name, F.lit(".txt")).alias("file_name"), F.col("context").alias("text"))


def unique_ids(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Repeated ids but the first get a hash of their text as suffix."""
    w = Window.partitionBy(key).orderBy("pos")
    suffix = F.concat(F.col(key), F.lit("_"), F.substring(F.sha1("text"), 1, 8))
    return rows.withColumn("_r", F.row_number().over(w)).withColumn(key, F.when(F.col("_r") == 1, F.col(key)).otherwise(suffix)).drop("_r")


def walk_corpus(rows: DataFrame) -> DataFrame:
    """doc_id, text of every text-bearing object in nested JSON, depth first, not below one that has text.

    rows: root string, json string.
    """
    import json

    def found(node, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(node, dict):
            text = next((node[k] for k in TEXT_KEYS if isinstance(node.get(k), str) and node[k].strip()), None)
            if text is not None:
                yield str(node.get("doc_id") or node.get("id") or path), text
                return
            for k, v in node.items():
                yield from found(v, f"{path}/{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from found(v, f"{path}/{i}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.itertuples() for x in found(json.loads(r.json), r.root)], columns=["doc_id", "text"])

    return rows.select("root", "json").mapInPandas(run, "doc_id string, text string")


def normalize_questions(rows: DataFrame, json: str = "json") -> DataFrame:
    """question_id (or a hash of the question), question, answers, rationale from JSON records."""
    get = lambda k: F.get_json_object(F.col(json), f"$.{k}")
    question = F.coalesce(get("question"), get("query"))
    qid = F.coalesce(*[get(k) for k in ID_KEYS], F.substring(F.sha1(question), 1, 12))
    evidence = F.from_json(get("evidence"), "array<string>")
    return rows.select(
        qid.alias("question_id"), question.alias("question"), normalize_answers(F.coalesce(get("answers"), get("answer"))).alias("answers"),
        F.coalesce(get("rationale"), F.array_join(evidence, "\n")).alias("rationale"),
    )


def normalize_answers(c: Column) -> Column:
    """Null: none; a JSON list: its items; else the value alone."""
    listed = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.trim(c).startswith("["), F.coalesce(listed, F.array(c))).otherwise(F.array(c))


def document_subset(questions: DataFrame, documents: DataFrame, doc_ids: Sequence[str], dataset: str, *, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the chosen documents, at most ``most`` questions each in file order; a missing id is an error."""
    wanted = F.broadcast(documents.sparkSession.createDataFrame([(d,) for d in doc_ids], "doc_id string"))
    lost = [r[0] for r in wanted.join(documents, "doc_id", "left_anti").collect()]
    if lost:
        raise ValueError(f"documents not found: {sorted(lost)}")
    kept = questions.join(wanted, "doc_id", "left_semi")
    if most is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("_r") <= most).drop("_r")
    return documents.join(wanted, "doc_id", "left_semi"), kept.withColumn("dataset", F.lit(dataset))


# --- table maintenance ---------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(rows: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Fields of ``change`` over those of rows where they are not null; unknown keys are ignored."""
    fields = [c for c in change.columns if c != key]
    new = change.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    have = set(rows.columns)
    picked = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in have else F.col(f"_{c}").alias(c) for c in fields]
    return rows.join(new, key, "left").select(*[c for c in rows.columns if c not in fields], *picked)


def latest(cache: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(key).orderBy(F.desc(pos))
    return cache.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pending(rows: DataFrame, done: DataFrame, key: str, *, reset: DataFrame | None = None) -> DataFrame:
    """Rows whose key has no ``ok`` in the log, or is to be done again."""
    ok = done.where("status = 'ok'").select(key).distinct()
    if reset is not None:
        ok = ok.join(reset.select(key), key, "left_anti")
    return rows.join(ok, key, "left_anti")


class Repository:
    """Tables under ``<root>/<namespace>/<name>``."""

    def __init__(self, spark: SparkSession, root: str, namespace: str):
        self.spark, self.at = spark, f"{root.rstrip('/')}/{namespace}"

    def save(self, name: str, df: DataFrame, *, recreate: bool = True) -> None:
        df.write.mode("overwrite" if recreate else "errorifexists").parquet(f"{self.at}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.at}/{name}")


def write_report(df: DataFrame, path: str, fields: Sequence[str], *, sep: str = ",") -> None:
    """Delimited text with a header; absent values are empty."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in fields]
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def markdown_table(df: DataFrame, fields: Sequence[str], *, most: int = 1000) -> str:
    """A report table: a bounded number of rows."""
    rows = df.select(*fields).limit(most).collect()
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(fields) + " |", "|" + "---|" * len(fields)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows])
