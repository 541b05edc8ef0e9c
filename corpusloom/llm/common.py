"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.base import table
from corpusloom.plans.tables import stored

__all__ = ["WORD", "long_id", "n_words", "stored", "table", "text_bytes"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    """The column as long; left as it is if it is one, so that equal scans stay equal plans."""
    return F.col(name) if df.schema[name].dataType.simpleString() == "bigint" else F.col(name).cast("long").alias(name)
