"""Registry of runnable queries and their DuckDB oracles.

A query is a callable ``(spark, sf_dir) -> DataFrame`` that builds its
fixtures and runs library operators.  Its oracle is independent SQL over the
same fixtures; fixtures are inlined as CTEs so DuckDB only needs the driver's
base tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.sources.fixtures import duck_ctes, fixture


@dataclass
class Query:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    fixtures: tuple


_QUERIES: dict[str, Query] = {}


class Inputs:
    """Lazy fixture access with one cache per query run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict = {}
        # event-time rules (windows, date keys, timestamp parsing) are
        # defined in UTC, like the oracle
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name, self._cache)


def register(key: str, fixtures=(), oracle: str | None = None):
    """Decorator: ``fn(inputs) -> DataFrame`` becomes query ``key``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        sql = None
        if oracle is not None:
            prefix = duck_ctes(*fixtures)
            body = oracle.lstrip()
            if prefix and body[:5].lower() == "with ":
                body = ", " + body[5:]
            sql = prefix + body
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = Query(key, run, sql, tuple(fixtures))
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from corpusflow.plans import load_all  # noqa: F401

    load_all()
    return dict(_QUERIES)
