"""Registry of runnable queries: a Spark callable, and the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemspark.fixtures import Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame``; ``sql`` may use ``[view]`` for fixture views."""

    def wrap(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap
