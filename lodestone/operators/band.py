"""Band and nearest joins without nested loops: an equi-join on key and bucket, with neighbouring buckets exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_pos: str, right_pos: str, width: float) -> DataFrame:
    """All pairs with equal ``on`` and |left_pos - right_pos| <= width. The right side is copied to three buckets.

    It's a sort-merge join at every size: Spark's estimate of the right side leaves out the rows that an ``explode`` makes, here
    and in the caller, so it would send all of them to the driver as a broadcast."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("_b", bucket(left_pos))
    b = right.withColumn("_b", F.explode(F.array(bucket(right_pos) - 1, bucket(right_pos), bucket(right_pos) + 1)))
    return a.join(b.hint("merge"), [*on, "_b"]).filter(F.abs(F.col(left_pos) - F.col(right_pos)) <= width).drop("_b")


def nearest_within(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str], left_pos: str, right_pos: str, width: float, ties: str) -> DataFrame:
    """For each left row (named by ``key``) its nearest right row within the width; ties go to the smaller ``ties``."""
    pairs = band_join(left, right, on, left_pos, right_pos, width)
    others = [c for c in pairs.columns if c not in key]
    best = F.min_by(F.struct(*others), F.struct(F.abs(F.col(left_pos) - F.col(right_pos)), F.col(ties)))
    return pairs.groupBy(*key).agg(best.alias("_m")).select(*key, "_m.*")


def tick_values(labels: DataFrame, ticks: DataFrame, width: float = 15.0) -> DataFrame:
    """(image, axis, tick, value): the numbers of labels (image, seq, text, cx, cy, origin_x, origin_y) at ticks (image, axis,
    tick, ordinal). A label below the origin belongs to the x axis, one left of it to the y axis; it names the first tick
    less than ``width`` away; of several labels at a tick the last counts."""
    number = F.regexp_extract("text", r"[-+]?\d+(?:\.\d+)?", 0)
    axis = F.when(F.col("cy") > F.col("origin_y"), "x").when(F.col("cx") < F.col("origin_x"), "y")
    rows = labels.withColumn("axis", axis).filter((number != "") & F.col("axis").isNotNull())
    rows = rows.select("image", "axis", "seq", number.cast("double").alias("value"), F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy")).cast("double").alias("pos"))
    met = band_join(rows, ticks, ["image", "axis"], "pos", "tick", width).filter(F.abs(F.col("pos") - F.col("tick")) < width)
    named = met.groupBy("image", "axis", "seq").agg(F.min_by(F.struct("tick", "value"), "ordinal").alias("_t"))
    return named.groupBy("image", "axis", F.col("_t.tick").alias("tick")).agg(F.max_by("_t.value", "seq").alias("value"))


def mean_inside(pixels: DataFrame, boxes: DataFrame, value: str) -> DataFrame:
    """(image, box, mean): the mean of ``value``, a hue say, over the pixels (image, px, py) in each box (image, box, left, right, top, bottom)."""
    inside = (F.col("px") >= F.col("left")) & (F.col("px") < F.col("right")) & (F.col("py") >= F.col("top")) & (F.col("py") < F.col("bottom"))
    return pixels.join(boxes, "image").filter(inside).groupBy("image", "box").agg(F.avg(value).alias("mean"))
