"""Ordered-sequence operators: curve cleaning, axis calibration, islands and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.folds import ordered_fold


def series_points(df: DataFrame, json_col: str = "series") -> DataFrame:
    """A JSON cell {x_attr, y_attr, x[], y[]} as one row (x_attr, y_attr, seq, x, y) per point.

    Cells that can't be parsed, name an unknown attribute or hold arrays of different lengths give no rows."""
    parsed = F.from_json(json_col, "x_attr string, y_attr string, x array<double>, y array<double>")
    rows = df.withColumn("_s", parsed).filter(
        "_s is not null and size(_s.x) = size(_s.y) and size(_s.x) > 0 and coalesce(_s.x_attr, 'Unknown') <> 'Unknown' and coalesce(_s.y_attr, 'Unknown') <> 'Unknown'"
    )
    keep = [c for c in df.columns if c != json_col]
    exploded = rows.select(*keep, "_s.x_attr", "_s.y_attr", F.posexplode(F.arrays_zip("_s.x", "_s.y")).alias("seq", "p"))
    return exploded.select(*keep, "x_attr", "y_attr", "seq", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def first_per_x(df: DataFrame, curve: str, order: str) -> DataFrame:
    """The first point of each x of a curve, by ``order``."""
    best = df.groupBy(curve, "x").agg(F.min_by("y", order).alias("y"), F.min(order).alias(order))
    return best.select(curve, order, "x", "y")


def max_per_x(df: DataFrame, curve: str, digits: int = 3) -> DataFrame:
    return df.groupBy(curve, F.round("x", digits).alias("x")).agg(F.max("y").alias("y"))


def rolling_median_filter(df: DataFrame, curve: str, window: int = 5, sigmas: float = 2.0, slack: float = 5.0) -> DataFrame:
    """Points near the centred rolling median: |y - median| < sigmas * std(y - median) + slack. Curves of up to
    ``window`` points stay as they are. The standard deviation is that of a sample."""
    half, whole = window // 2, Window.partitionBy(curve)
    around = whole.orderBy("x").rowsBetween(-half, half)
    med = df.withColumns({"median": F.percentile("y", F.lit(0.5)).over(around), "n": F.count(F.lit(1)).over(whole)})
    off = med.withColumn("off", F.col("y") - F.col("median")).withColumn("spread", F.stddev_samp("off").over(whole))
    return off.filter((F.col("n") <= window) | (F.abs("off") < F.lit(sigmas) * F.col("spread") + F.lit(slack))).drop("n", "off", "spread")


def neighbour_filter(df: DataFrame, curve: str, order: str = "x", reach: int = 2, sigmas: float = 3.0, share: float = 0.2) -> DataFrame:
    """Flags points that differ from their neighbours (``reach`` rows on either side, themselves left out) by more
    than ``sigmas`` population deviations and more than ``share`` of the neighbours' median."""
    w = Window.partitionBy(curve).orderBy(order)
    near = F.array_sort(F.concat(F.collect_list("y").over(w.rowsBetween(-reach, -1)), F.collect_list("y").over(w.rowsBetween(1, reach))))
    rows = df.withColumn("_n", near)
    size = F.size("_n")
    median = (F.element_at("_n", F.floor((size + 1) / 2).cast("int")) + F.element_at("_n", F.floor(size / 2).cast("int") + 1)) / 2
    # one pass of running means, as databases do it: where a point is off by exactly the limit, rounding decides
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(s: Column, v: Column) -> Column:
        n = s["n"] + 1.0
        mean = s["mean"] + (v - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    spread = F.aggregate("_n", start, add, lambda s: F.sqrt(F.try_divide(s["squares"], s["n"])))
    rows = rows.withColumns({"_s": spread, "neighbour_median": F.when(size > 0, median)})
    std = F.greatest("_s", F.lit(1e-5))
    off = F.abs(F.col("y") - F.col("neighbour_median"))
    outlier = (off > F.lit(sigmas) * std) & (off > F.lit(share) * F.abs("neighbour_median"))
    return rows.withColumn("outlier", F.coalesce(F.when(size > 0, outlier), F.lit(False))).drop("_n", "_s")


def linear_calibration(df: DataFrame, axis: str, px: str, value: str) -> DataFrame:
    """Least-squares line value = slope * px + intercept of each axis."""
    return df.groupBy(axis).agg(F.regr_slope(value, px).alias("slope"), F.regr_intercept(value, px).alias("intercept"), F.count(F.lit(1)).alias("n_ticks"))


def apply_axis(px: Column, slope: Column, intercept: Column, is_log: Column, low: Column, high: Column) -> Column:
    """Pixel to value on a linear or logarithmic axis, kept within the axis."""
    linear = slope * px + intercept
    return F.greatest(low, F.least(high, F.when(is_log, F.pow(F.lit(10.0), linear)).otherwise(linear)))


def log_scale(df: DataFrame, axis: str, px: str, value: str, min_ratio: float = 1.5, max_spread: float = 0.2) -> DataFrame:
    """Whether an axis is logarithmic: at least three ticks, all positive, with steady ratios of neighbours."""
    w = Window.partitionBy(axis).orderBy(px)
    ratios = df.withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(w)))
    stats = ratios.groupBy(axis).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col(value) > 0).alias("positive"), F.avg("_r").alias("mean_ratio"), F.stddev_pop("_r").alias("std_ratio")
    )
    steady = (F.col("mean_ratio") > min_ratio) & (F.try_divide("std_ratio", "mean_ratio") < max_spread)
    return stats.withColumn("is_log", F.coalesce((F.col("n") >= 3) & F.col("positive") & steady, F.lit(False)))


def adjacent_slopes(df: DataFrame, axis: str, px: str, value: str) -> DataFrame:
    """``df`` with ``slope`` from the tick before; null for the first and between ticks at one place."""
    w = Window.partitionBy(axis).orderBy(px)
    return df.withColumn("slope", F.try_divide(F.col(value) - F.lag(value).over(w), F.col(px) - F.lag(px).over(w)))


def median_slope(df: DataFrame, axis: str, px: str, value: str) -> DataFrame:
    return adjacent_slopes(df, axis, px, value).groupBy(axis).agg(F.median("slope").alias("median_slope"))


def anchored_filter(df: DataFrame, axis: str, px: str, value: str, share: float = 0.2, least: float = 0.1) -> DataFrame:
    """Ticks that fit the median slope, each measured from the last tick that was kept; the first always stays."""
    ticks = df.select(axis, F.col(px).cast("double").alias(px), F.col(value).cast("double").alias(value)).join(median_slope(df, axis, px, value), axis)

    def step(last, x, y, slope):
        if last is None:
            return (x, y), True
        expected = None if slope is None else (x - last[0]) * slope
        fits = expected is not None and abs(y - last[1] - expected) <= max(abs(expected) * share, least)
        return ((x, y) if fits else last), fits

    ticks = ticks.filter(F.col(px).isNotNull() & F.col(value).isNotNull())
    return ordered_fold(ticks, axis, [px, value], [px, value, "median_slope"], step, T.StructField("_fits", T.BooleanType())).filter("_fits").select(axis, px, value)


def islands(df: DataFrame, group: str, pos: str, gap: int = 10, bucket: int = 1 << 16) -> DataFrame:
    """Runs of positions with gaps of at most ``gap``: (group, island, first, last, n).

    Runs are found inside buckets of positions, so a group is shared by many tasks, and stitched by their ends."""

    def runs(rows: DataFrame, key: list[str], first: Column, last: Column) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(first)
        start = F.when(first - F.lag(last).over(w) <= gap, 0).otherwise(1)
        return rows.withColumn("_s", start).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    at = F.col(pos)
    local = runs(df.withColumn("_b", F.floor(at / F.lit(bucket))), [group, "_b"], at, at)
    local = local.groupBy(group, "_b", "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")
    whole = runs(local, [group], F.col("first"), F.col("last"))
    return whole.groupBy(group, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def peaks(df: DataFrame, group: str, pos: str, count: str, floor: int = 100) -> DataFrame:
    """Histogram bins above the floor and above both neighbours (missing neighbours count as 0)."""
    w = Window.partitionBy(group).orderBy(pos)
    return df.withColumns({"_a": F.coalesce(F.lag(count).over(w), F.lit(0)), "_b": F.coalesce(F.lead(count).over(w), F.lit(0))}).filter(
        (F.col(count) > floor) & (F.col(count) > F.col("_a")) & (F.col(count) > F.col("_b"))
    ).drop("_a", "_b")


def within_bounds(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points whose x and y lie in their attributes' ranges (attr, low, high); attributes without a range pass."""
    x, y = (ranges.select(F.col("attr").alias(f"{c}_attr"), F.col("low").alias(f"_{c}lo"), F.col("high").alias(f"_{c}hi")) for c in "xy")
    both = points.join(x, "x_attr", "left").join(y, "y_attr", "left")
    fine = [F.coalesce(F.col(c).between(F.col(f"_{c}lo"), F.col(f"_{c}hi")), F.lit(True)) for c in "xy"]
    return both.filter(fine[0] & fine[1]).drop("_xlo", "_xhi", "_ylo", "_yhi")


def value_span(df: DataFrame, group: str, value: str, share: float = 0.3) -> DataFrame:
    """Text of a series' values: "min-max" where they spread by more than ``share`` of the maximum, else the maximum."""
    stats = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    text = lambda c: F.format_string("%.2f", F.col(c))
    return stats.withColumn("span", F.when(F.col("hi") - F.col("lo") > F.lit(share) * F.abs("hi"), F.concat(text("lo"), F.lit("-"), text("hi"))).otherwise(text("hi")))


def second_difference_fit(y, weight: float = 0.5):
    """The z that minimises sum (y - z)^2 + weight * sum (second differences of z)^2, for four values or more.

    Its matrix I + weight * D'D has five diagonals, so elimination and substitution take time and memory in proportion to
    the number of values."""
    import numpy as np

    n = len(y)
    ones = np.ones(n - 2)
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)  # the diagonal and those to its right
    for shift, c in enumerate((1.0, -2.0, 1.0)):
        main[shift : n - 2 + shift] += weight * c * c * ones
    one[: n - 2] += weight * -2.0
    one[1 : n - 1] += weight * -2.0
    two[: n - 2] += weight
    d, l1, l2, z = main.tolist(), one.tolist(), two.tolist(), np.asarray(y, float).tolist()
    for i in range(n):  # L D L'
        if i >= 1:
            a1 = l1[i - 1] * d[i - 1]
            d[i] -= l1[i - 1] * a1
            l1[i] -= l2[i - 1] * a1
            z[i] -= l1[i - 1] * z[i - 1]
        if i >= 2:
            d[i] -= l2[i - 2] ** 2 * d[i - 2]
            z[i] -= l2[i - 2] * z[i - 2]
        l1[i], l2[i] = l1[i] / d[i], l2[i] / d[i]
    for i in reversed(range(n)):
        z[i] = z[i] / d[i] - (l1[i] * z[i + 1] if i + 1 < n else 0.0) - (l2[i] * z[i + 2] if i + 2 < n else 0.0)
    return np.array(z)


def smoothed(df: DataFrame, curve: str, points: int = 50) -> DataFrame:
    """A smooth curve through each curve's points: penalised least squares on second differences, evaluated on an
    even grid. The curve is first reduced to the largest y per x and to points that agree with their neighbours."""
    reduced = neighbour_filter(max_per_x(df, curve), curve).filter(~F.col("outlier")).select(curve, "x", "y")

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("x")
        x, y = pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        if len(x) > 3:
            grid = np.linspace(x[0], x[-1], points)
            y = np.interp(grid, x, second_difference_fit(y))
            x = grid
        return pd.DataFrame({curve: pdf[curve].iloc[0], "x": x, "y": y})

    return reduced.groupBy(curve).applyInPandas(fit, f"{curve} {dict(df.dtypes)[curve]}, x double, y double")
