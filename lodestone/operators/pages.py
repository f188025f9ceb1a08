"""Documents as pages and lines, page scores and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# fixed values: thresholds at which a page goes to the table, plot and text stage
ROUTES = {"tables_pages": ("table_score", 0.4), "plots_pages": ("plot_score", 0.4), "text_pages": ("text_score", 0.25)}
# fixed values: words of lines that speak of theory, trends or methods; words are of A-Z, a-z, 0-9 and _
THEORETICAL = r"(?i)(?<!\w)(?:calculated|simulated|theoretical|predicted|expected|estimated|modeled)(?!\w)"
TREND = r"(?i)(?<!\w)(?:increased|decreased|higher|lower|better|worse|improved|reduced|dropped|rose|trend)(?!\w)"
METHOD = r"(?i)(?<!\w)(?:prepared|synthesized|washed|heated|cooled|stirred|mixed|added|dropwise|annealed)(?!\w)"


def lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line, content), lines numbered from 0."""
    return df.select(key, F.posexplode(F.split(text_col, "\n")).alias("line", "content"))


def pages(df: DataFrame, key: str, text_col: str, chars: int = 1_000) -> DataFrame:
    """(key, page, content): the text in pages of ``chars`` characters, numbered from 1."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text_col) / F.lit(chars))).cast("int")
    numbered = df.select(key, F.col(text_col).alias("_t"), F.explode(F.sequence(F.lit(1), count)).alias("page"))
    return numbered.select(key, "page", F.expr(f"substring(_t, (page - 1) * {chars} + 1, {chars})").alias("content"))


def line_context(df: DataFrame, key: str) -> DataFrame:
    """Each line with the lines before and after it."""
    w = Window.partitionBy(key).orderBy("line")
    return df.withColumn("context", F.concat_ws(" ", F.lag("content").over(w), "content", F.lead("content").over(w)))


def measured_lines(df: DataFrame) -> DataFrame:
    """Lines with a value and unit that don't speak of theory, trends or methods."""
    c = F.col("content")
    return df.filter(~c.rlike(THEORETICAL) & ~c.rlike(TREND) & ~c.rlike(METHOD) & c.rlike(r"\d+(?:\.\d+)?\s*[a-zA-Z%/µ·²]"))


def before_references(df: DataFrame, key: str) -> DataFrame:
    """Lines up to a references heading in a document's second half, cut only past 70 % of its lines."""
    whole = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(whole)
    heading = F.col("content").rlike(r"(?i)^\s*(?:references|bibliography)\s*$") & (F.col("line") > n * 0.5)
    rows = df.withColumns({"_n": n, "_h": heading.cast("int")})
    seen = F.max("_h").over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_s", seen).filter((F.col("_s") == 0) | (F.col("line") <= F.col("_n") * 0.7)).drop("_n", "_h", "_s")


def ignored_section(df: DataFrame, key: str) -> Column:
    """Pages that end in references within the last fifth of a document, and pages of acknowledgements."""
    last = F.max("page").over(Window.partitionBy(key))
    low = F.lower("content")
    tail = F.right(low, F.lit(1000))
    return ((F.col("page") > last * 0.8) & tail.rlike("references|bibliography")) | low.contains("acknowledgement")


def sampled_text(df: DataFrame, key: str) -> DataFrame:
    """(key, text): a document's first three pages and its pages dense in numbers, in order."""
    c = F.col("content")
    dense = (tx.numeric_density(c) > 0.05) & (tx.n_numbers(c) >= 5)
    some = df.filter((F.col("page") <= 3) | dense)
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "content"))), lambda p: p["content"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_pages"))


def text_score(content: Column, units: str, keywords: str, reach: int = 80) -> Column:
    """Density of measurements: 1 for each near a keyword, .2 for each other; 8 and more score 1, 4 .75, 1 .4.

    Each measurement has its own window, ``reach`` characters before and after it; one keyword may vouch for several."""
    low = F.lower(content)
    number = r"\d+(?:\.\d+)?(?:e[-+]?\d+)?"
    measured = rf"{number}\s*(?:{units})(?![a-z0-9])"
    found = F.regexp_extract_all(low, F.lit(measured), F.lit(0))

    def one(st: Column, m: Column) -> Column:
        begin = st["end"] + F.length(m["gap"])
        end = begin + F.length(m["text"])
        first = F.greatest(F.lit(0), begin - reach)
        near = F.substring(low, first + 1, end + reach - first).rlike(keywords)
        return F.struct(end.alias("end"), (st["close"] + near.cast("int")).alias("close"))

    each = F.zip_with(F.slice(F.split(low, measured), F.lit(1), F.size(found)), found, lambda gap, text: F.struct(gap.alias("gap"), text.alias("text")))
    close = F.aggregate(each, F.struct(F.lit(0).alias("end"), F.lit(0).alias("close")), one, lambda st: st["close"])
    points = F.round(close + (F.size(found) - close) * 0.2, 1)  # tenths, so that five isolated ones make 1
    return F.when(points >= 8, 1.0).when(points >= 4, 0.75).when(points >= 1, 0.4).otherwise(0.0)


def table_score(n_tables: Column, numeric_cells: Column, cells: Column, mean_columns: Column) -> Column:
    """min(1, .3 + .1 per table + half the share of numeric cells + a bonus for width); 0 without tables."""
    width = F.least(F.lit(0.2), F.greatest(F.lit(0.0), (mean_columns - 2) * 0.05))
    score = 0.3 + 0.1 * n_tables + 0.5 * F.coalesce(F.try_divide(numeric_cells, cells), F.lit(0.0)) + width
    return F.when(n_tables > 0, F.least(F.lit(1.0), score)).otherwise(0.0)


def plot_score(model: Column, local: Column, long_lines: Column, drawings: Column) -> Column:
    """.6 model + .4 local, or .4 local without a model's score; vector pages score at least .4."""
    raster = F.when(model.isNotNull(), 0.6 * model + 0.4 * local).otherwise(0.4 * local)
    return F.greatest(F.coalesce(raster, F.lit(0.0)), F.when((long_lines >= 2) & (drawings > 20), 0.4).otherwise(0.0))


def route(df: DataFrame, key: str) -> DataFrame:
    """(key, tables_pages, plots_pages, text_pages): sorted page numbers, a page possibly in several."""
    picked = [F.array_sort(F.collect_set(F.when(F.col(score) >= least, F.col("page")))).alias(name) for name, (score, least) in ROUTES.items()]
    return df.groupBy(key).agg(*picked)


def routed_or_default(files: DataFrame, routing: DataFrame, key: str) -> DataFrame:
    """Every file with its text pages; files without routing get pages 1 to 3."""
    default = F.array(*[F.lit(i) for i in (1, 2, 3)])
    return files.join(routing, key, "left").select(key, F.coalesce("text_pages", default).alias("pages"))
