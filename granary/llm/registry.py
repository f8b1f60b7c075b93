"""Gathers the queries and SQL of the subpackage."""

from __future__ import annotations

import importlib

MODULES = ("queries_docs", "queries_tokens", "queries_pages", "queries_chat", "queries_vectors", "queries_fim", "queries_mix", "queries_words")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"granary.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
