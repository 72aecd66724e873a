"""Retrieval-quality measures: recall, rescue, deltas, rollups and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def recall(matched: Column, expected: Column) -> Column:
    """Share of the expected set that was matched; null if nothing is expected."""
    return F.size(F.array_intersect(expected, matched)) / F.nullif(F.size(F.array_distinct(expected)), F.lit(0))


def rollup_means(runs: DataFrame, sets: list[list[str]], metric: str) -> DataFrame:
    """Mean, count and spread of a metric over grouping sets; missing values don't count."""
    every = sorted({c for s in sets for c in s})
    grouped = runs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    return grouped.agg(F.round(F.avg(metric), 6).alias("mean"), F.count(metric).alias("n"), F.grouping_id().cast("long").alias("level"))


def pivot_delta(runs: DataFrame, key: str, config: str, metric: str, left: str, right: str) -> DataFrame:
    return runs.groupBy(key).pivot(config, [left, right]).agg(F.avg(metric)).select(key, F.round(F.col(left) - F.col(right), 6).alias("delta"))


def rescued(facts: DataFrame, config: str, fact: str, left: str, right: str) -> DataFrame:
    """Facts that one configuration matches and another doesn't, and their share of all facts."""
    universe = facts.agg(F.countDistinct(fact).alias("universe"))
    only = facts.filter(F.col(config) == left).select(fact).distinct().join(facts.filter(F.col(config) == right).select(fact).distinct(), fact, "left_anti")
    return only.agg(F.count("*").alias("rescued")).join(F.broadcast(universe)).select("rescued", "universe", F.round(F.col("rescued") / F.col("universe"), 6).alias("rate"))


def privilege(left: DataFrame, right: DataFrame, key: str, metric: str) -> DataFrame:
    both = left.select(key, F.col(metric).alias("a")).join(right.select(key, F.col(metric).alias("b")), key, "full")
    d = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return both.select(key, F.when(d > EPSILON, "improved").when(d < -EPSILON, "regressed").otherwise("unchanged").alias("change"))


def saturated(runs: DataFrame, config: str, pool: str, metric: str) -> DataFrame:
    """Configurations whose mean does not depend on the pool's size."""
    means = runs.groupBy(config, pool).agg(F.round(F.avg(metric), 6).alias("m"))
    return means.groupBy(config).agg((F.min("m") == F.max("m")).alias("saturated"))


def verdict(gain: Column, redundancy: Column, cases: Column) -> Column:
    return F.when(cases < 5, "INSUFFICIENT").when((gain <= 0) & (redundancy >= 0.9), "REMOVE").when(gain <= 0.02, "REDUCE").otherwise("KEEP")
