"""Queries and their SQL by name, gathered from the modules of plans."""

from __future__ import annotations

from .plans import corpus_queries, fragment_queries, graph_queries, symbol_queries

MODULES = (graph_queries, corpus_queries, fragment_queries, symbol_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
