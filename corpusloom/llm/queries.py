"""Queries of the training-data operators and their SQL, as registered by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: name -> (module, SQL constant or None)
_OPS: dict[str, tuple[str, str | None]] = {
    "op1_url_filters": ("urls", None),
    "op2_sentencepiece": ("pieces", None),
    "op3_substring_dedup": ("substring", None),
    "op4_language_id": ("langid", None),
    "op5_chat_formatting": ("chat", "OP5_SQL"),
    "op6_jaccard_join": ("jaccard", None),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op8_quality_rules": ("quality_rules", None),
    "op9_quality_classifier": ("resampling", None),
    "op10_nearest_neighbours": ("hilbert", None),
    "op11_survivorship": ("survivorship", "OP11_SQL"),
    "op12_merkle_manifest": ("merkle", "OP12_SQL"),
    "op13_packing": ("packing", None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(import_module(f"corpusloom.llm.{m}"), n) for n, (m, _) in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: getattr(import_module(f"corpusloom.llm.{m}"), s) for n, (m, s) in _OPS.items() if s}
