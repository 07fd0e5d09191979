"""All queries of the library, by name, each with its SQL where SQL can express it.

A query is a function (spark, sf_dir) -> DataFrame. Its SQL may name the domain tables of ``domain.VIEWS``; those it names
are put in front as common table expressions.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("evidence", "review", "dedupe", "vector", "style", "pixels", "coverage", "export", "incremental", "registry", "roundtrip")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def with_views(sql: str) -> str:
    """``sql`` behind the domain tables it names, and those that they name."""
    from quarrykit.plans.domain import VIEWS

    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {views} {body}"


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"quarrykit.operators.{m}")
    importlib.import_module("quarrykit.streaming.tail")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: with_views(v) for k, v in _SQL.items()}
