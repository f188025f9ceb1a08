"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tagged_csv(spark: SparkSession, path: str, tag: str) -> DataFrame | None:
    """A CSV with a header, all columns text, with its source; null if it is missing or has no rows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return None if not df.columns or df.isEmpty() else df.withColumn("_source", F.lit(tag))


def aliases_json(spark: SparkSession, path: str) -> DataFrame:
    """{attribute: {aliases, units, range}} as rows (attribute, ordinal, aliases, units, low, high)."""
    raw = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<aliases: array<string>, units: array<string>, range: array<double>>>"
    names = F.json_object_keys("value")
    rows = raw.select(F.posexplode(names).alias("ordinal", "attribute"), F.from_json("value", kind).alias("m"))
    entry = F.element_at("m", F.col("attribute"))
    return rows.select("attribute", "ordinal", entry["aliases"].alias("aliases"), entry["units"].alias("units"), F.get(entry["range"], F.lit(0)).alias("low"), F.get(entry["range"], F.lit(1)).alias("high"))


def screening_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Screening results with nested hits and measurements: an object a line, or one array."""
    kind = (
        "file string, include boolean, score double, paper_type string, reason string, keyword_hits array<struct<term: string, attribute: string, strength: string>>, "
        "measurements array<struct<value: string, unit: string, attribute: string>>, matched_pairs array<string>, attributes_matched array<string>"
    )
    return spark.read.schema(kind).option("multiLine", not lines).json(path)


def routing_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.schema("file string, tables_pages array<int>, plots_pages array<int>, text_pages array<int>").option("multiLine", not lines).json(path)


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Overwrite as CSV with a header; nulls are blank. With an order the files are sorted ranges."""
    (df.orderBy(*order) if order else df).na.fill("").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Progressive append; columns may be added later (read with mergeSchema)."""
    df.write.mode("append").parquet(path)


def write_panels(points: DataFrame, path: str) -> None:
    """One folder of JSON points per digitised panel (File, Image_ID)."""
    points.write.mode("overwrite").partitionBy("File", "Image_ID").json(path)


def digitized_points(series: DataFrame) -> DataFrame:
    """Series with nested points as long rows; ``series`` is (File, Page, Image_ID, Series_Name, points, units, titles)."""
    keep = [c for c in series.columns if c != "points"]
    rows = series.select(*keep, F.explode("points").alias("p"))
    return rows.select(*keep, F.col("p.x").alias("X_Value"), F.col("p.y").alias("Y_Value"))


def split_errors(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is a number, and the log (File, Severity, Message) of the others."""
    number = F.col(value).try_cast("double")
    log = df.filter(number.isNull()).select("File", F.lit("WARN").alias("Severity"), F.concat(F.lit("not a number: "), F.coalesce(F.col(value), F.lit(""))).alias("Message"))
    return df.filter(number.isNotNull()), log


def preview(df: DataFrame, rows: int = 1000) -> DataFrame:
    return df.na.fill("").limit(rows)


def cited_files(df: DataFrame) -> DataFrame:
    """Distinct files of a result."""
    return df.select("File").dropna().distinct()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (file, length, content) for a page-text function."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.substring_index("path", "/", -1).alias("file"), "length", "content")
