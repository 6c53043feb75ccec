"""All named queries of the core library."""

from __future__ import annotations

from . import adapter_queries, core, map_queries, page_queries, web_queries

_MODULES = (core, web_queries, map_queries, page_queries, adapter_queries)


def core_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def core_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
