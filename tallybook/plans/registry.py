"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from .testbed import PRELUDE, Testbed

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(testbed) -> DataFrame`` under ``key``; ``sql`` may start with further CTEs."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[key] = PRELUDE + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
        return fn

    return register
