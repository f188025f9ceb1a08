"""Queries of schema inference, figures and model hooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import figures, models, pages, schema
from lodestone.plans.registry import query, table

KINDS = [["F/g"], [], ["%"], ["zz", "nm"], None]


@query(
    """select p_partkey, case when p_partkey % 5 in (1, 4) or p_partkey % 7 = 0 then 'string' else 'float' end as type,
  case p_partkey % 5 when 0 then 'capacitance_per_mass' when 2 then 'percentage' when 3 then 'length' end as dimension,
  case when p_partkey % 5 in (1, 4) or p_partkey % 7 = 0 then 'not_numeric' when p_partkey % 5 = 2 then 'unit_required,range_0_100' else 'unit_required' end as rules,
  case p_partkey % 5 when 0 then 5e6 when 2 then 100.0 when 3 then 1000.0 end::double as high from part"""
)
def infer_schema(spark, sf_dir):
    units = F.lit(None).cast("array<string>")
    for i, u in enumerate(KINDS):
        if u is not None:
            units = F.when(F.col("p_partkey") % 5 == i, F.array(*map(F.lit, u)).cast("array<string>")).otherwise(units)
    name = F.concat(F.lit("attr "), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, " material").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("attribute"), units.alias("units"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    out = schema.infer(rows.drop("p_partkey")).join(rows.select("p_partkey", "attribute"), "attribute")
    return out.select("p_partkey", "type", "dimension", F.array_join("rules", ",").alias("rules"), "high")


@query("select p_partkey, p_partkey % 3 <> 1 as compatible from part")
def compatible_units(spark, sf_dir):
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, "F/g").when(k == 1, "Wh/kg").otherwise("odd")
    b = F.when(k == 0, "mF g-1").when(k == 1, "W/kg").otherwise("odd")
    return schema.compatible(table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b")), "a", "b").select("p_partkey", "compatible")


@query(
    """select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as key, arg_min(p_partkey, p_partkey) as ordinal from (select p_partkey, unnest([p_name, p_type]) as name from part) group by 1"""
)
def alias_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("attribute"), F.col("p_partkey").alias("ordinal"), F.array("p_type").alias("aliases"))
    return schema.alias_index(rows).select("key", "ordinal")


@query("select c_custkey, c_custkey % 3 <> 0 as is_float, c_custkey % 3 = 1 as is_int from customer")
def value_types(spark, sf_dir):
    k = F.col("c_custkey")
    cell = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(k, F.lit(".5")))
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", schema.valid_type(cell, F.lit("float")).alias("is_float"), F.coalesce(schema.valid_type(cell, F.lit("int")) & ~cell.contains("."), F.lit(False)).alias("is_int"))


@query("select p_partkey, p_name || case when contains(p_name, 'red') then '' else ' red' end || case when contains(p_name, 'steel') then '' else ' Steel' end as refined from part")
def refined_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", schema.refined_query(F.col("p_name"), F.array(F.lit("red"), F.lit("Steel"))).alias("refined"))


@query()
def clustered_boxes(spark, sf_dir):
    """Boxes merged until none meet: the outcome of one merge decides the next."""
    p = F.col("p_partkey").cast("double")
    boxes = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("box"), (p * 131 % 3000).alias("x0"), (p * 77 % 3000).alias("y0"))
    return figures.clustered_boxes(boxes.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 25}), ["p_brand"])


@query(
    """select user_id, arg_max(event_id, (event_id % 97, event_id)) filter (event_id % 2 = 0) as x_axis, arg_min(event_id, (event_id % 89, event_id)) filter (event_id % 2 = 1) as y_axis from events group by 1"""
)
def axis_lines(spark, sf_dir):
    e = F.col("event_id")
    lines = table(spark, sf_dir, "events").select("user_id", e.alias("line"), (e % 2 == 0).alias("horizontal"), (e % 89).alias("x"), (e % 97).alias("y"))
    return figures.axis_lines(lines, "user_id")


@query("select p_brand, arg_max(p_partkey, (p_size * (p_partkey % 10 + 1), -p_partkey)) as box, max(p_size * (p_partkey % 10 + 1)) as area from part group by 1")
def largest_box(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("box"), F.col("p_size").alias("w"), (F.col("p_partkey") % 10 + 1).alias("h"))
    return figures.largest_box(rows, "p_brand")


@query(
    """select user_id, event_type as shape, cast(round((event_id * 7 % 250) / 32.0) * 32 as integer) as r, cast(round((event_id * 3 % 250) / 32.0) * 32 as integer) as g, 64 as b, count(*) as n, avg(event_id % 100) as mean_x from events group by all"""
)
def marker_groups(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("shape"), (e * 7 % 250).alias("r"), (e * 3 % 250).alias("g"), F.lit(60).alias("b"), (e % 100).alias("x"))
    return figures.marker_groups(rows, "user_id")


@query("select event_type as image, event_id % 180 as hue, count(*) as n from events group by all")
def hue_histogram(spark, sf_dir):
    return figures.hue_histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), (F.col("event_id") % 180).alias("hue")), "image")


@query("select event_type as image, event_id % 64 as y, cast(sum(event_id % 256) as bigint) as total from events group by all")
def projection_sums(spark, sf_dir):
    e = F.col("event_id")
    out = figures.projections(table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), (e % 64).alias("y"), (e % 256).alias("v")), "image", "y", "v")
    return out


@query(
    """with t as (select p_partkey as image, case p_partkey % 3 when 0 then 'b' when 1 then 'c' end as x, case p_partkey % 2 when 0 then 'b' end as y from part),
d as (select image, coalesce(x, 'a') as x, coalesce(y, 'b') as y from t) select image, x as x_attr, case when x = y then (case when x = 'a' then 'b' else 'a' end) else y end as y_attr from d"""
)
def axes_of_series(spark, sf_dir):
    k = F.col("p_partkey")
    titles = table(spark, sf_dir, "part").select(k.alias("image"), F.when(k % 3 == 0, "b").when(k % 3 == 1, "c").alias("x_attr"), F.when(k % 2 == 0, "b").alias("y_attr"))
    return figures.axes_of_series(titles, ["a", "b", "c"])


@query()
def token_budget_batches(spark, sf_dir):
    """Running sums that start anew with each batch; tests hold them against a loop."""
    lines = pages.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return models.token_batches(lines.select("doc_id", "line", F.length("content").alias("tokens")), "doc_id", "line", "tokens", 500)


def _stub(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: what it says follows from the text's length."""
    return ["MEASUREMENT" if len(p) % 2 else "REJECT" for p in prompts]


@query("select p_partkey, p_name from part where p_partkey % 3 <> 0 or length(p_name) % 2 = 1")
def confirmed_cells(spark, sf_dir):
    """Ambiguous cells stay only if the model confirms them."""
    cells = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 3 == 0).alias("ambiguous"))
    answers = models.ask(cells.filter("ambiguous"), "p_partkey", "p_name", _stub)
    return models.keep_confirmed(cells, answers, "p_partkey").select("p_partkey", "p_name")


@query("select p_partkey from part where p_partkey % 3 <> 0")
def ambiguous_cells_without_model(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 3 == 0).alias("ambiguous"))
    return models.keep_confirmed(cells, models.ask(cells, "p_partkey", "p_name", None), "p_partkey").select("p_partkey")


@query("select p_partkey from part where length(p_name) % 2 = 1")
def accepted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return models.accept_rows(rows, models.ask(rows, "p_partkey", "p_name", _stub), "p_partkey").select("p_partkey")


@query("select p_partkey, p_size::double as value, p_name from part where (p_partkey % 10) / 10.0 >= 0.70")
def confirmed_measurements(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    answer = F.to_json(F.struct(F.lit("a").alias("attribute"), F.col("p_size").cast("double").alias("value"), F.lit("nm").alias("unit"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence")))
    out = models.confirmed_measurements(part.select("p_partkey", answer.alias("answer")), part.select("p_partkey", "p_name"), "p_partkey")
    return out.select("p_partkey", "value", "p_name")


@query("select p_partkey, case p_partkey % 2 when 0 then 'pore size' else 'Energy-Density' end as attribute from part where p_partkey % 3 <> 0")
def requested_attributes(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "colour").when(k % 2 == 0, "Pore_Size").otherwise("energy density")
    requested = spark.createDataFrame([("pore size",), ("Energy-Density",)], "attribute string")
    return models.requested_only(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), requested).select("p_partkey", "attribute")


@query(
    r"""with w as (select item_id, string_split(text, ' ') as ws from benchmark), p as (select item_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as word from w),
s as (select item_id, w, word, sum(length(w) + 1) over (partition by item_id order by word) - length(w) - 1 as start from p)
select item_id, word, (start + length(w) // 2)::bigint as pos from s"""
)
def offset_to_word(spark, sf_dir):
    """The word number of an offset inside every word: one pass over word starts and offsets, nothing is split again."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("word", "w"))
    before = F.sum(F.length("w") + 1).over(Window.partitionBy("item_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    starts = words.select("item_id", "word", F.coalesce(before, F.lit(0).cast("long")).alias("pos"), F.length("w").alias("n"))
    offsets = starts.select("item_id", (F.col("pos") + F.floor(F.col("n") / 2)).alias("pos"))
    return schema.words_at(starts.drop("n"), offsets, "item_id").select("item_id", F.col("word").cast("long").alias("word"), "pos")
