"""Extracted tables as long cells (table_id, row, col, cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def header_rows(cells: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, n_header): leading rows, at most ``most``, while text cells outnumber numeric ones; the first row that
    fails ends the header."""
    blank = F.coalesce(F.trim("cell"), F.lit("")) == ""
    numeric = F.col("cell").rlike("[0-9]")
    rows = cells.filter(F.col("row") < most).groupBy(key, "row").agg((F.count_if(~numeric & ~blank) > F.count_if(numeric)).cast("int").alias("texty"))
    still = F.min("texty").over(Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_s", still).groupBy(key).agg(F.sum("_s").cast("long").alias("n_header"))


def sample_values(cells: DataFrame, headers: DataFrame, key: str, rows: int = 5, most: int = 3) -> DataFrame:
    """(key, col, samples): the first three non-blank cells of the five rows below the header."""
    body = cells.join(headers, key).filter((F.col("row") >= F.col("n_header")) & (F.col("row") < F.col("n_header") + rows))
    some = body.filter(F.coalesce(F.trim("cell"), F.lit("")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda s: s["cell"])
    return some.groupBy(key, "col").agg(F.slice(ordered, 1, most).alias("samples"))


# fixed values: words of a cell that describes, and units that may be a condition's
CELL_WORDS = ("synthesis", "preparation", "method", "prepared", "sample", "material")
AMBIGUOUS_UNITS = ("a/g", "x", "c", "v", "mv/s", "ma/c", "k", "h")


def is_value_cell(cell):
    """Short, on one line, with a digit, and no description."""
    return (F.length(cell) <= 50) & ~cell.contains("\n") & cell.rlike("[0-9]") & ~cell.rlike(rf"(?i)\b(?:{'|'.join(CELL_WORDS)})\b")


def ambiguous(unit, header_confidence):
    """Cells that need a second look: a condition's unit, or none under a weak header."""
    return F.coalesce(F.lower(unit).isin(*AMBIGUOUS_UNITS), F.lit(False)) | (F.coalesce(unit, F.lit("")).isin("") & (header_confidence < 0.75))


def attributed_cells(cells: DataFrame, header_attrs: DataFrame, key: str) -> DataFrame:
    """Cells with the attribute of their column; columns without one and cells beyond the header's width are dropped."""
    return cells.join(header_attrs, [key, "col"])
