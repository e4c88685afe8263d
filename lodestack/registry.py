"""All queries of the core and their SQL, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sync", "retrieval", "graphs", "texts", "memories", "code")
FLAGSHIP = "hybrid_search"

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f".plans.{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
