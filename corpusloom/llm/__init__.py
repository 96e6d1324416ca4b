"""Operators of a training-data pipeline; nothing outside this folder imports them."""


def load():
    """(queries by name, SQL by name)."""
    from . import queries

    return dict(queries.QUERIES), dict(queries.SQL)
