"""Collects the named queries of this package."""

from __future__ import annotations

from . import activity, crawling, directory, gates, highlighting, legacy, linking, naming, officers, projections, records, retrying, texts

_MODULES = (activity, crawling, directory, gates, highlighting, legacy, linking, naming, officers, projections, records, retrying, texts)


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
