"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
all but the last with the columns of documents.  A document is dropped by quality rules if they do
not keep it; near duplicates leave the smallest doc_id of each class; substring deduplication takes
repeated passages out of the texts, and a document whose words are all taken goes; mixing gives a row
per whole copy of a document and one for the selected part of a further copy; tokens are the last.
``n_chars`` follows a changed text.

Defined results: null and empty texts and documents of fewer than 50 words go in the first stage; of rows
with equal doc_id the second keeps one, the smallest by its other columns, nulls first; rows with null doc_id
stay as long as their texts do, and match nothing; empty tables give no rows; without labels of both kinds
the base rules alone decide; further columns of documents pass through every stage but the last.
Tables between stages lie in the application's folder of the shared folder and go with the application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, mixing, pieces, quality_rules, substring
from corpusloom.llm.common import WORD, stored, table

#: The stages hold trained trees and hashed windows, which SQL cannot express.
ORACLE_SQL = None


def _columns(df: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs from kept_*, with those in ``new`` replaced."""
    out = []
    for f in docs.schema:
        c = new.get(f.name, F.col("doc_id") if f.name == "doc_id" else F.col(f"`kept_{f.name}`"))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _others(docs: DataFrame, *but: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", *but))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    judged = quality_rules.judge(docs, model, keep=_others(docs))
    return _columns(judged.where("kept"), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard.similar_classes(docs.select("doc_id", "text"))
    stay = classes.where("doc_id = component_id").select("doc_id").distinct()
    rest = F.struct(*[F.col(c) for c in _others(docs)])
    kept = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("_row")).select("doc_id", "_row.*")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(docs, keep=_others(docs, "text"), source=True)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("source_text")).otherwise(F.col("kept"))
    return _columns(out, docs, text=text, n_chars=F.char_length(text))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs, keep=_others(docs)).where("taken > 0")
    words = F.regexp_extract_all("kept_text", F.lit(WORD), F.lit(0))
    part = F.transform(
        F.array(words),
        lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), " "),
    )[0]
    whole = F.when(F.col("copies") > 0, F.array_repeat(F.col("kept_text"), F.col("copies").cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.when(F.size("spans") > 0, F.concat(whole, F.array(part))).otherwise(whole)
    out = out.withColumn("mixed_text", F.explode(texts))
    return _columns(out, docs, text=F.col("mixed_text"), n_chars=F.char_length("mixed_text"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
