"""Registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from lexmill.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    """Every query of the library by name."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the name of the query."""
    _load()
    return dict(SQL)


def _load() -> None:
    from lexmill.plans import forms, graph, legal, metrics, pages, regulations, reports, rules, scores, text  # noqa: F401
