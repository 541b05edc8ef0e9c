"""Incremental ingestion: documents that arrive in a folder are parsed, chunked and mined as they come.

Parsing, chunking and extraction are local to a document, so a micro-batch adds rows and nothing
else; merged entities and relations are aggregates over the appended tables, computed when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents as D
from corpusloom.operators import graphs as G


def ingest(spark: SparkSession, inbox: str, out: str, *, lines_per_chunk: int = 4, pattern: str = G.ENTITY):
    """A query that appends to ``<out>/chunks``, ``<out>/mentions`` and ``<out>/relations``.

    Batches are written under their number, so a repeated batch replaces its own rows.
    """
    incoming = spark.readStream.schema("doc_id string, file_name string, text string").json(inbox)

    def add(batch: DataFrame, number: int) -> None:
        chunks = D.line_windows(D.lines(batch, max_line_tokens=0), lines_per_chunk)
        named = G.extract(chunks, pattern=pattern).persist()
        for name, df in (("chunks", named), ("mentions", G.mentions(named)), ("relations", G.co_occurrences(named))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        named.unpersist()

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/_progress")


def entities(spark: SparkSession, out: str) -> DataFrame:
    return G.merge_entities(spark.read.parquet(f"{out}/mentions").drop("batch"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Trace events by user and session window; works on streams, dropping what is later than ``late``."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value"
    )
