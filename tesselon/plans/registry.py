"""Where queries and their SQL are kept."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) under its name, with the same result in SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
