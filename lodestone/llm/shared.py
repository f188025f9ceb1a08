"""Tables written to the folder that the whole cluster shares, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session without it gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again. The files go when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    store, where = _hadoop(df.sparkSession, path)
    store.deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    store, where = _hadoop(df.sparkSession, df._lodestone_path)
    store.delete(where, True)


class Scratch:
    """Tables of a computation that nothing reads any more when it ends."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(written(df, name))

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def drop(self) -> None:
        for t in self.tables:
            drop_written(t)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def sampled(df: DataFrame, n: int, total: int, *key: Column | str) -> DataFrame:
    """``n`` rows of ``df``, which has ``total``, chosen by a hash of ``key``; all of them if there are fewer.

    Rows whose hash is far from the smallest are filtered first, so that the sort sees about 4 n of them."""
    h = F.xxhash64(F.lit(11), *key)
    if total > 8 * n:
        df = df.filter(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 4 * n / total))
        h = F.pmod(h, F.lit(1 << 40))
    return df.orderBy(h, *key).limit(n)
