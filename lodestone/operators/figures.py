"""Relational cores of figure reading, over boxes, points and pixels given as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clustered_boxes(df: DataFrame, page: list[str], reach: float = 100.0) -> DataFrame:
    """Drawing boxes (page..., box, x0, y0, x1, y1) merged where they meet when inflated by ``reach``, again and
    again; one row per cluster with its bounds and the number of boxes.

    A page has some hundred drawings and is folded as a unit: merging depends on what was merged before."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = [[*r, 1] for r in pdf.sort_values("box")[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)]
        changed = True
        while changed:
            changed, out = False, []
            for b in boxes:
                for c in out:
                    if b[0] - reach <= c[2] and c[0] - reach <= b[2] and b[1] - reach <= c[3] and c[1] - reach <= b[3]:
                        c[:] = [min(c[0], b[0]), min(c[1], b[1]), max(c[2], b[2]), max(c[3], b[3]), c[4] + b[4]]
                        changed = True
                        break
                else:
                    out.append(b)
            boxes = out
        rows = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1", "n"])
        for c in page:
            rows[c] = pdf[c].iloc[0]
        return rows[[*page, "x0", "y0", "x1", "y1", "n"]]

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in page), "x0 double, y0 double, x1 double, y1 double, n long"])
    return df.groupBy(*page).applyInPandas(fold, schema)


def axis_lines(lines: DataFrame, image: str) -> DataFrame:
    """The bottom-most horizontal and the left-most vertical line of each image; ``lines`` is (image, line, horizontal, x, y)."""
    return lines.groupBy(image).agg(
        F.max_by("line", F.when(F.col("horizontal"), F.struct("y", "line"))).alias("x_axis"), F.min_by("line", F.when(~F.col("horizontal"), F.struct("x", "line"))).alias("y_axis")
    )


def largest_box(boxes: DataFrame, image: str) -> DataFrame:
    return boxes.groupBy(image).agg(F.max_by("box", F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("box")).alias("b"))).alias("box"), F.max(F.col("w") * F.col("h")).alias("area"))


def marker_groups(markers: DataFrame, image: str, step: int = 32) -> DataFrame:
    """Markers of one shape and one colour, colours being rounded to steps: (image, shape, r, g, b, n, mean x)."""
    rounded = [(F.round(F.col(c) / step) * step).cast("int").alias(c) for c in "rgb"]
    return markers.groupBy(image, "shape", *rounded).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


def hue_histogram(pixels: DataFrame, image: str) -> DataFrame:
    return pixels.groupBy(image, "hue").agg(F.count(F.lit(1)).alias("n"))


def projections(pixels: DataFrame, image: str, axis: str, value: str) -> DataFrame:
    """Sums of a value along one axis, for finding the gaps between panels."""
    return pixels.groupBy(image, axis).agg(F.sum(value).alias("total"))


# fixed values: caption words of micrographs and drawings
MICROSCOPY_WORDS = ("tem", "sem", "afm", "scale bar", "magnification", "nanometer", "μm", "nm")
DRAWING_WORDS = ("setup", "scheme", "illustration", "proposed", "apparatus", "diagram")
LEAST_SCORE = 40  # figures below it aren't digitised


def caption_signal(caption: Column) -> Column:
    """What a caption's words speak for: microscopy before schematic, else graph."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    has = lambda words: low.rlike(rf"\b(?:{'|'.join(words)})\b")
    return F.when(has(MICROSCOPY_WORDS), "microscopy").when(has(DRAWING_WORDS), "schematic").otherwise("graph")


def figure_score(axes: Column, ticks: Column, signal: Column) -> Column:
    """40 for axes, 30 for ticks, and by the caption's signal 30 for a graph, less 60 for microscopy or 40 for a drawing; at least 0."""
    by_signal = F.when(signal == "graph", 30).when(signal == "microscopy", -60).otherwise(-40)
    return F.greatest(F.lit(0), F.when(axes, 40).otherwise(0) + F.when(ticks, 30).otherwise(0) + by_signal)


def simple_plot(series: Column, most: int = 10) -> Column:
    """Few enough series to be told apart."""
    return F.size(series) <= most


def large_enough(width: Column, height: Column, least: int = 150) -> Column:
    return (width >= least) & (height >= least)


def plausible_plot_value(value: Column) -> Column:
    return (value > -1000) & (value < 100_000)


def axes_of_series(titles: DataFrame, attributes: list[str]) -> DataFrame:
    """(image, x_attr, y_attr): matched attributes of both axes; unmatched ones take the first two of the schema, and
    where both would be the same the y axis takes the next."""
    first, second = F.lit(attributes[0]), F.lit(attributes[min(1, len(attributes) - 1)])
    x, y = F.coalesce("x_attr", first), F.coalesce("y_attr", second)
    return titles.select("image", x.alias("x_attr"), F.when(x == y, F.when(x == first, second).otherwise(first)).otherwise(y).alias("y_attr"))
