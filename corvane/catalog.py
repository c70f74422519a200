"""All queries outside ``corvane.llm``, with their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under ``name``, and the SQL that gives the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from corvane.plans import maintenance, relational, retrieval, upkeep, vectors  # noqa: F401


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
