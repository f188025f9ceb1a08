"""Hooks for models. A model is a function from a list of texts to a list of answers; without one the deterministic
fallbacks apply: measurements none, ambiguous cells dropped (fail closed), rows accepted (fail open)."""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.folds import ordered_fold

Model = Callable[[list[str]], list[str]]


def token_batches(df: DataFrame, key: str, order: str, tokens: str, budget: int = 3500) -> DataFrame:
    """``df`` with ``batch``: rows of a key in order, a new batch where the budget would be exceeded.

    The running sum starts anew with each batch. A missing number of tokens counts as 0."""

    def step(state, n):
        total, batch = state or (0, 0)
        if total and total + (n or 0) > budget:
            total, batch = 0, batch + 1
        return (total + (n or 0), batch), batch

    return ordered_fold(df, key, [order], [tokens], step, T.StructField("batch", T.IntegerType()))


def ask(df: DataFrame, key: str, prompt: str, model: Model | None) -> DataFrame:
    """(key, answer): a batch of prompts per call; without a model or after its error no rows."""
    schema = f"{key} {dict(df.dtypes)[key]}, answer string"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = model(pdf[prompt].tolist())
            except Exception:  # noqa: BLE001  a failing model counts as no answer
                continue
            yield pd.DataFrame({key: pdf[key], "answer": answers})

    return df.select(key, prompt).mapInPandas(run, schema)


def confirmed_measurements(answers: DataFrame, lines: DataFrame, key: str, least: float = 0.70) -> DataFrame:
    """Answers (JSON with attribute, value, unit, confidence) that are sure enough, with their source lines."""
    parsed = answers.select(key, F.from_json("answer", "attribute string, value double, unit string, confidence double").alias("m")).select(key, "m.*")
    return parsed.filter(F.col("confidence") >= least).join(lines, key)


def keep_confirmed(cells: DataFrame, answers: DataFrame, key: str, least: float = 0.70) -> DataFrame:
    """Unambiguous cells, and ambiguous ones that a model confirms as measurements; without answers they are dropped.

    Answers with a ``confidence`` count from ``least`` on."""
    sure = answers.filter(F.col("confidence") >= least) if "confidence" in answers.columns else answers
    yes = sure.filter(F.upper("answer") == "MEASUREMENT").select(key).distinct()
    return cells.filter(~F.col("ambiguous")).unionByName(cells.filter("ambiguous").join(yes, key, "left_semi"))


def accept_rows(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Rows except those that a model rejects."""
    return rows.join(answers.filter(F.upper("answer") == "REJECT").select(key).distinct(), key, "left_anti")


def requested_only(answers: DataFrame, requested: DataFrame) -> DataFrame:
    """Answers (name, ...) whose name is a requested attribute, punctuation and case aside."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return answers.join(requested.select("attribute", key(F.col("attribute")).alias("_k")), key(F.col("name")) == F.col("_k")).drop("_k")


def vocabulary(*lists: DataFrame) -> DataFrame:
    """(word): the lower-cased words of all lists (word), each once."""
    return reduce(DataFrame.unionByName, lists).select(F.lower("word").alias("word")).filter("word <> ''").distinct()


UNKNOWN_HEADER = "UNKNOWN_NOISE"  # fixed value: what a model answers for a header of no attribute


def reviewed_headers(headers: DataFrame, answers: DataFrame, key: str, header: str = "header") -> DataFrame:
    """``headers`` (key, header, attribute, unit, confidence) with what a model said of them, where it named an attribute.

    An answer is JSON with ``headers``, a list of original_header, mapped_attribute, extracted_unit and confidence, or
    that list alone. Headers are taken as they are written; of several answers for one the surest counts, then the first by
    attribute and unit. A missing confidence is 0. Without answers, or where they name none, the match by rules stands."""
    item = "array<struct<original_header: string, mapped_attribute: string, extracted_unit: string, confidence: double>>"
    listed = F.coalesce(F.get_json_object("answer", "$.headers"), F.col("answer"))
    said = answers.select(key, F.explode(F.from_json(listed, item)).alias("h")).select(
        key, F.col("h.original_header").alias("_h"), F.col("h.mapped_attribute").alias("_a"), F.col("h.extracted_unit").alias("_u"), F.coalesce("h.confidence", F.lit(0.0)).alias("_c")
    )
    said = said.filter((F.col("_h") != "") & (F.col("_a") != "") & (F.col("_a") != UNKNOWN_HEADER))
    best = said.groupBy(key, "_h").agg(F.min(F.struct((-F.col("_c")).alias("c"), "_a", "_u")).alias("_m")).withColumnRenamed("_h", header)
    both = headers.join(best, [key, header], "left")
    told = F.col("_m").isNotNull()
    return both.withColumns({
        "attribute": F.when(told, F.col("_m._a")).otherwise(F.col("attribute")),
        "unit": F.when(told, F.col("_m._u")).otherwise(F.col("unit")),
        "confidence": F.when(told, -F.col("_m.c")).otherwise(F.col("confidence")),
    }).drop("_m")
