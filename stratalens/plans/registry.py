"""The named queries, and the SQL that states the same result for DuckDB.

A query is a function (spark, sf_dir) -> DataFrame over the driver's tables. Its SQL may use
the relations of ``store.SQL`` by name; those it names are put in front as common table
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def with_relations(sql: str) -> str:
    """``sql`` with the relations it uses, and theirs, in front."""
    from .store import SQL

    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(SQL[name])
    parts = [f"{name} AS ({SQL[name]})" for name in SQL if name in needed]
    if not parts:
        return sql
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body[m.end() :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, covers: str = ""):
    """Registers a query, its SQL and the numbers of the operators it shows."""

    def wrap(f: Callable[..., DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        OPERATORS[name] = covers
        if sql:
            ORACLES[name] = with_relations(sql)
        return f

    return wrap
