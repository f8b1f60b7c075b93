"""Gathers the queries and SQL of the reference's operators."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("retrieval", "figures", "news", "answers", "filings")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"granary.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
