"""Acquisition of papers as relational operators: federated scans, deduplication, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import title_key


def federated(engines: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """All engines' rows with the engine's rank; columns that an engine lacks become null."""
    tagged = [df.withColumns({"engine": F.lit(name), "engine_rank": F.lit(i)}) for i, (name, df) in enumerate(engines.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def new_papers(found: DataFrame, stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """Papers whose DOI and title aren't stored yet, each title and DOI once: the first by ``order``."""
    keyed = found.withColumn("_t", title_key(F.col("title")))
    fresh = keyed.join(stored.select(title_key(F.col("title")).alias("_t")).distinct(), "_t", "left_anti")
    fresh = fresh.join(stored.select(F.lower("doi").alias("_d")).filter("_d is not null").distinct(), F.lower("doi") == F.col("_d"), "left_anti")
    for key in (F.col("_t"), F.coalesce(F.lower("doi"), F.col("_t"))):
        w = Window.partitionBy(key).orderBy(*order)
        fresh = fresh.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return fresh.drop("_t")


def accepted(found: DataFrame, gate: float, target: int, order: Sequence[str]) -> DataFrame:
    """The first ``target`` papers that pass the relevance gate: the limit is the feature."""
    return found.filter(F.col("relevance_score") >= gate).orderBy(*order).limit(target)


def distinct_phrases(df: DataFrame, key: str, phrase: str, order: str) -> DataFrame:
    """Phrases once whatever their case, in order of first appearance."""
    w = Window.partitionBy(key, F.lower(phrase)).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def expired(df: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """Rows older than ``days`` before the newest."""
    newest = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) < newest - F.expr(f"interval {days} days"))
