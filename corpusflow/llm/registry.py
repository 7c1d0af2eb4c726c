"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("queries_rules", "queries_tokens", "queries_text", "queries_dups", "queries_vectors")

_QUERIES: dict[str, "LlmQuery"] = {}


@dataclass
class LlmQuery:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def query(key: str, oracle: str | None = None):
    def deco(fn):
        _QUERIES[key] = LlmQuery(key, fn, oracle)
        return fn

    return deco


def all_queries() -> dict[str, LlmQuery]:
    for m in MODULES:
        importlib.import_module(f"corpusflow.llm.{m}")
    return dict(_QUERIES)
