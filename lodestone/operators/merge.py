"""Consolidation of candidates from several sources into one row per file.

Candidates are long rows (file, attr, source, value, confidence, proof) plus columns that give their input order.
Everything that says "first" uses those order columns, never the physical order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: sources in order of trust, and the confidence of a candidate that carries none
SOURCES = {"table": 0.9, "plot": 0.7, "text": 0.6}
TABLE_FLOOR, VERITAS_THRESHOLD = 0.8, 0.95


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name with the source and its ordinal; columns that a source lacks become null."""
    tagged = [df.withColumns({"source": F.lit(name), "source_ordinal": F.lit(i)}) for i, (name, df) in enumerate(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def priority(source: Column) -> Column:
    whens = F.when(F.lit(False), 0)
    for i, name in enumerate(SOURCES, 1):
        whens = whens.when(source == name, i)
    return whens.otherwise(len(SOURCES) + 1)


def effective_confidence(source: Column, confidence: Column) -> Column:
    """The candidate's confidence or its source's default; a table's is at least the floor."""
    default = F.lit(None).cast("double")
    for name, value in SOURCES.items():
        default = F.when(source == name, value).otherwise(default)
    own = F.coalesce(confidence, default, F.lit(0.5))
    return F.when((source == "table") & (own < TABLE_FLOOR), TABLE_FLOOR).otherwise(own)


def is_missing(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("", "nan", "None")


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Candidates ranked within (file, attr): best source, then confidence, then input order; with the runner-up."""
    good = df.filter(~is_missing(F.col("value")))
    good = good.withColumns({"priority": priority(F.col("source")), "conf": effective_confidence(F.col("source"), F.col("confidence"))})
    w = Window.partitionBy("file", "attr").orderBy("priority", F.col("conf").desc(), *order)
    return good.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("value").over(w)})


def consolidate(df: DataFrame, order: Sequence[str], veritas: bool = True) -> DataFrame:
    """One row (file, attr, value, source, conf) per file and attribute; ``value`` is null where it is rejected.

    With ``veritas`` the best candidate needs the threshold unless it is from a table, and the two best candidates
    must agree whatever their case. Only the best two per group are ranked before the shuffle."""
    best = ranked(df, order).filter("rank = 1")
    if not veritas:
        return best.select("file", "attr", "value", "source", "conf")
    weak = (F.col("conf") < VERITAS_THRESHOLD) & (F.col("source") != "table")
    conflict = F.coalesce(F.lower("runner_up") != F.lower("value"), F.lit(False))
    return best.select("file", "attr", F.when(~(weak | conflict), F.col("value")).alias("value"), "source", "conf")


def joined_proofs(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(file, proof): the non-blank proofs of a file in row order."""
    some = df.filter(~is_missing(F.col("proof")))
    rows = F.array_sort(F.collect_list(F.struct(*order, "proof")))
    return some.groupBy("file").agg(F.array_join(F.transform(rows, lambda r: r["proof"]), " | ").alias("proof"))


def wide(consolidated: DataFrame, proofs: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """One row per file: an attribute a column, proof and source_summary; blank where nothing was accepted.

    Files without any accepted attribute are dropped."""
    taken = consolidated.filter(F.col("value").isNotNull() & F.col("attr").isin(list(attrs)))
    cells = [F.coalesce(F.max(F.when(F.col("attr") == a, F.col("value"))), F.lit("")).alias(a) for a in attrs]
    origin = [F.max(F.when(F.col("attr") == a, F.concat(F.lit(f"{a}←"), F.col("source")))) for a in attrs]
    rows = taken.groupBy("file").agg(*cells, F.concat_ws(", ", *origin).alias("source_summary"))
    return rows.join(proofs, "file", "left").select("file", *attrs, F.coalesce("proof", F.lit("")).alias("proof"), "source_summary")


def append_points(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Consolidated rows and curve-point rows, without exact duplicates; missing cells are blank."""
    both = rows.unionByName(points, allowMissingColumns=True).distinct()
    return both.na.fill("", [f.name for f in both.schema if f.dataType.simpleString() == "string"])


def drop_blank(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Rows with at least one attribute that isn't blank."""
    return df.filter(reduce(lambda a, b: a | b, (~is_missing(F.col(a)) for a in attrs)))


HIDDEN = ("File", "Title", "source_file", "filename", "source", "formula_used")  # fixed values: columns that a table of results doesn't show


def shown_columns(df: DataFrame) -> DataFrame:
    """The columns of a result that are shown beside its name: no names of files and sources, no flags, no reasons."""
    return df.select(*[c for c in df.columns if c not in HIDDEN and not c.endswith("_flag") and "reasons" not in c])
