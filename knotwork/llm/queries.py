"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_embedding_near_dedup": "grid_join",
    "op2_document_fingerprints": "minhash",
    "op3_ngram_jaccard_join": "jaccard_join",
    "op4_chat_formatting": "chat",
    "op5_pii_extraction": "pii",
    "op6_balanced_sharding": "sharding",
    "op7_best_fit_packing": "packing",
    "op8_url_filters": "url_filter",
    "op9_source_mixing": "mixing",
    "op10_quality_classifier": "quality",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f".{module}", __package__).query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
