"""Exact deduplication by a content sort.

Sampled splitters range-partition the texts, each partition is sorted externally so that equal texts are
neighbours, and neighbours are compared in full. Only DataFrame operations are used.

The splitters are sampled over (leading characters, 64-bit hash, salt) rather than over whole texts, so the
sample that reaches the driver has a fixed width however long the texts are; the sort and the comparison of
neighbours use the whole text. A text with more than 1/``HOT_SHARE`` of all rows (at most ``HOT_SHARE`` such
texts can exist, which bounds the broadcast) gets a salt from its row id, so that its copies spread over many
partitions as several runs; the few run summaries are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 2048  # a text is hot when it has more than rows / HOT_SHARE copies
HOT_MIN = 200  # and at least so many
SALTS = 1024  # runs into which a hot text is split
PREFIX = 32  # leading characters that the splitters see


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every input row, its columns renamed c0, c1, ... (the text: ``_text``, never null, and ``_null``), with the
    result columns of its group."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    row_id, others = F.col(names[id_col]), [n for c, n in names.items() if c != text_col]
    base = df.toDF(*names.values()).withColumns({"_text": F.coalesce(names[text_col], F.lit("")), "_null": F.col(names[text_col]).isNull()})
    base = base.select(*others, "_text", "_null", F.xxhash64("_text").alias("_hash"))
    counts = base.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg(F.sum("_n") / F.lit(HOT_SHARE)).scalar()
    hot = counts.filter((F.col("_n") >= HOT_MIN) & (F.col("_n") > share)).select("_hash", F.lit(True).alias("_hot"))
    flagged = base.join(F.broadcast(hot), "_hash", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))

    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(row_id), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    keys = ["_prefix", "_hash", "_salt"]
    run = Window.partitionBy(*keys, "_text")

    def runs(rows: DataFrame) -> DataFrame:
        placed = rows.withColumns({"_prefix": F.substring("_text", 1, PREFIX), "_salt": salt}).repartitionByRange(*keys)
        ranked = placed.withColumn("_rank", F.row_number().over(run.orderBy(row_id.desc_nulls_last())))
        sized = ranked.withColumns({"_run_keep": F.max(row_id).over(run), "_run_size": F.count(F.lit(1)).over(run)})
        return sized.withColumn("text_sha256", F.sha2("_text", 256))

    merged = (
        runs(flagged.filter("_hot").select(names[id_col], "_text", "_hash", "_hot"))
        .filter("_rank = 1")
        .groupBy("text_sha256")
        .agg(F.max("_run_keep").alias("_keep"), F.sum("_run_size").alias("_size"))
    )
    joined = runs(flagged).join(F.broadcast(merged), "text_sha256", "left")
    joined = joined.withColumn("keep_id", F.when(F.col("_hot"), F.col("_keep")).otherwise(F.col("_run_keep")))
    return joined.select(
        *others, "_text", "_null", "keep_id",
        F.when(F.col("_hot"), F.col("_size")).otherwise(F.col("_run_size")).alias("group_size"),
        ((F.col("_rank") == 1) & row_id.eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so all null and empty texts form one group. The largest id of a group stays;
    null ids stay only in groups without any other id. Of repeated rows with the same id and text exactly one
    stays. Other columns of the input are ignored, an empty table gives an empty result.
    """
    rows = _grouped(df.select(id_col, text_col), id_col, text_col)
    return rows.select(F.col("c0").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all columns of the input."""
    rows = _grouped(df, id_col, text_col).filter("kept")
    text = F.when(~F.col("_null"), F.col("_text"))
    return rows.select(*[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])
