"""Catalog of registered queries."""

import importlib

MODULES = ["knowledge", "content", "topics", "operations", "streams"]


def load():
    """(queries by name, SQL by name)."""
    from .registry import QUERIES, SQL

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(QUERIES), dict(SQL)
