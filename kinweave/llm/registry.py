"""All queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["groups", "forms", "spellings", "places", "linkage", "packing", "leaks", "personal"]


def _modules() -> list:
    return [importlib.import_module(f"kinweave.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.oracle_sql().items()}
