"""Registry of named queries: a Spark builder and (optionally) an equivalent DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    """Decorator: ``@register("sent_bleu4", SQL)`` on ``fn(spark, sf_dir) -> DataFrame``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco
