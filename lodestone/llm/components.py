"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """From (u, v): (node, root), root being the smallest node connected with node, for every node that isn't a
    root. The number of rounds grows with the logarithm of the longest path; each round is written to the shared
    folder. No task gathers a node's neighbours: minima are combined before the shuffle and joined back."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.*").filter("u <> v").distinct(), "edges")
        drop_written(now)
        now = after
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen or not n:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._lodestone_path = now._lodestone_path
            return out
        seen = (n, mark)
