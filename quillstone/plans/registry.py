"""A group of queries: functions registered with their SQL (None where SQL cannot express them)."""

from __future__ import annotations


def group() -> tuple[dict, dict, object]:
    queries: dict = {}
    sql: dict = {}

    def register(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, register
