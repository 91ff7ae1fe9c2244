"""Query catalog: every registered key has a Spark callable ``(spark, sf_dir)
-> DataFrame`` and, where SQL can express it, a DuckDB oracle over the raw test
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from helpline.plans import q_kb, q_search, q_calls, q_text, q_stream, q_io  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}
