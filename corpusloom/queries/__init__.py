"""Registered queries: each operator applied to whole tables, with SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(fn: Callable[[Tables], DataFrame]):
        REGISTRY[fn.__name__] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return add


def load() -> dict[str, Query]:
    from . import aggregates, audits, filters_joins, graph_queries, papers, retrieval, scalars, scopes, sequences, stores, workflow, works  # noqa: F401

    return REGISTRY
