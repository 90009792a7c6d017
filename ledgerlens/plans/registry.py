"""All registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import cost_oracles, cost_queries, snapshot_oracles, snapshot_queries, store_oracles, store_queries


def _configured(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir.rstrip("/"))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for registry in (cost_queries.QUERIES, snapshot_queries.QUERIES, store_queries.QUERIES):
        for key, fn in registry.items():
            out[key] = _configured(fn)
    return out


def all_oracles() -> dict[str, str]:
    out = {}
    out.update(cost_oracles.oracles())
    out.update(snapshot_oracles.oracles())
    out.update(store_oracles.oracles())
    return out
