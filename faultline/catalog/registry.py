"""Registered queries and their SQL counterparts."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from faultline.catalog.views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under its own name; ``sql`` may use the names of the shared views."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        assert fn.__name__ not in QUERIES, fn.__name__
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(ops.split()), run, with_views(sql) if sql else None)
        return fn
    return register
