"""Structured Streaming: deduplication with memory, windows and sessions. Extensions beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed, so the state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, ts: str, by: str, value: str, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet in ``folder``, which also holds its checkpoint, and read it."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_complete(aggregated: DataFrame, folder: str) -> DataFrame:
    """The same for an aggregate that is wanted whole and not only as far as its watermark is past: each batch replaces the
    rows in ``folder``, written by the executors."""
    target = f"{folder}/rows"

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    q = aggregated.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return aggregated.sparkSession.read.schema(aggregated.schema).parquet(target)
