"""All registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ("scans", "predicates", "joins", "aggregates", "windows", "ordering", "scalars", "retrieval", "documents", "evaluation", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)


def entry(spark, sf_dir):
    return queries()["i5_hybrid_search"](spark, sf_dir)
