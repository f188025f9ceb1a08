"""Queries of the ordered-sequence operators. A user's events are a curve: x is the rank, y the value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import band, curves
from lodestone.plans.registry import query, table

CURVE = "p as (select user_id as curve, cast(row_number() over (partition by user_id order by ts, event_id) as double) as x, value as y, event_id from events)"


def events_curve(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("curve"), rank.alias("x"), F.col("value").alias("y"), "event_id")


@query(
    f"""with {CURVE},
m as (select *, median(y) over (partition by curve order by x rows between 2 preceding and 2 following) as median, count(*) over (partition by curve) as n from p),
d as (select *, stddev_samp(y - median) over (partition by curve) as spread from m)
select curve, x, y, median from d where n <= 5 or abs(y - median) < 2 * spread + 5"""
)
def series_points_clean(spark, sf_dir):
    return curves.rolling_median_filter(events_curve(spark, sf_dir), "curve").select("curve", "x", "y", "median")


@query(
    f"""with {CURVE},
n as (select *, list(y) over (partition by curve order by x rows between 2 preceding and 1 preceding) as a, list(y) over (partition by curve order by x rows between 1 following and 2 following) as b from p),
s as (select curve, x, y, list_sort(list_concat(coalesce(a, []), coalesce(b, []))) as near from n),
t as (select *, len(near) as k, list_median(near) as med, greatest(list_stddev_pop(near), 1e-5) as sd from s)
select curve, x, y, coalesce(k > 0 and abs(y - med) > 3 * sd and abs(y - med) > 0.2 * abs(med), false) as outlier from t"""
)
def neighbour_outliers(spark, sf_dir):
    return curves.neighbour_filter(events_curve(spark, sf_dir), "curve").select("curve", "x", "y", "outlier")


@query("select l_orderkey as curve, cast(l_linenumber as double) as x, arg_min(l_quantity, (l_partkey, l_suppkey, l_extendedprice)) as y from lineitem group by 1, 2")
def first_point_per_x(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    order = F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord")
    rows = line.select(F.col("l_orderkey").alias("curve"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"), order)
    return curves.first_per_x(rows, "curve", "ord").select("curve", "x", "y")


@query("select l_suppkey as curve, round(l_discount + 0.0, 3) as x, max(l_extendedprice) as y from lineitem group by 1, 2")
def max_value_per_x(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("curve"), (F.col("l_discount") + 0.0).alias("x"), F.col("l_extendedprice").alias("y"))
    return curves.max_per_x(rows, "curve")


@query(
    """select o_orderpriority as axis, round(regr_slope(o_totalprice, px), 6) as slope, round(regr_intercept(o_totalprice, px), 3) as intercept, count(*) as n_ticks
from (select *, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) as px from orders) group by 1"""
)
def axis_calibration(spark, sf_dir):
    px = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("axis"), px.alias("px"), "o_totalprice")
    out = curves.linear_calibration(rows, "axis", "px", "o_totalprice")
    return out.select("axis", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_ticks")


@query(
    """select event_id, greatest(1.0, least(1000.0, case when event_type = 'click' then pow(10.0, 0.01 * (event_id % 400) - 0.5) else 2.5 * (event_id % 400) + 3 end)) as value from events"""
)
def axis_transform(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    is_log = F.col("event_type") == "click"
    slope, intercept = F.when(is_log, 0.01).otherwise(2.5), F.when(is_log, -0.5).otherwise(3.0)
    return ev.select("event_id", curves.apply_axis((F.col("event_id") % 400).cast("double"), slope, intercept, is_log, F.lit(1.0), F.lit(1000.0)).alias("value"))


TICKS = """t as (select s_nationkey as axis, cast(s_suppkey as double) as px,
  case when s_nationkey % 2 = 0 then pow(2.0, s_suppkey % 7) else s_acctbal end as v from supplier)"""


def ticks(spark, sf_dir):
    value = F.when(F.col("s_nationkey") % 2 == 0, F.pow(F.lit(2.0), F.col("s_suppkey") % 7)).otherwise(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("axis"), F.col("s_suppkey").cast("double").alias("px"), value.alias("v"))


@query(
    f"""with {TICKS}, r as (select *, v / lag(v) over (partition by axis order by px) as q from t),
s as (select axis, count(*) as n, bool_and(v > 0) as positive, avg(q) as m, stddev_pop(q) as sd from r group by axis)
select axis, n, coalesce(n >= 3 and positive and m > 1.5 and sd / m < 0.2, false) as is_log from s"""
)
def log_scale_test(spark, sf_dir):
    return curves.log_scale(ticks(spark, sf_dir), "axis", "px", "v").select("axis", "n", "is_log")


@query(
    f"""with {TICKS}, r as (select axis, (v - lag(v) over w) / (px - lag(px) over w) as slope from t window w as (partition by axis order by px))
select axis, median(slope) as median_slope from r group by axis"""
)
def median_tick_slope(spark, sf_dir):
    return curves.median_slope(ticks(spark, sf_dir), "axis", "px", "v")


@query()
def anchored_tick_filter(spark, sf_dir):
    """Each tick is compared with the last one kept, which plain SQL can't express; tests hold it against a loop."""
    return curves.anchored_filter(ticks(spark, sf_dir), "axis", "px", "v")


@query(
    """with e as (select event_type as g, event_id as pos from events),
s as (select *, case when pos - lag(pos) over (partition by g order by pos) <= 10 then 0 else 1 end as st from e),
i as (select *, sum(st) over (partition by g order by pos rows unbounded preceding) as island from s)
select g, cast(island as bigint) as island, min(pos) as first, max(pos) as last, count(*) as n from i group by g, island"""
)
def gaps_islands(spark, sf_dir):
    """All events: the gaps are those that the other types leave in a type's ids."""
    return curves.islands(table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("event_id").alias("pos")), "g", "pos")


@query(
    """with h as (select event_type as g, cast(floor(value) as bigint) as bin, count(*) as n from events group by 1, 2),
l as (select *, coalesce(lag(n) over w, 0) as a, coalesce(lead(n) over w, 0) as b from h window w as (partition by g order by bin))
select g, bin, n from l where n > 10 and n > a and n > b"""
)
def hist_peaks(spark, sf_dir):
    bins = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("g"), F.floor("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return curves.peaks(bins, "g", "bin", "n", floor=10)


@query(
    """select curve, 'rank' as x_attr, 'value' as y_attr, cast(x as double) as x, round(y, 4) as y from (
  select user_id as curve, row_number() over (partition by user_id order by ts, event_id) as x, value as y from events) where x between 2 and 40 and round(y, 4) between 1 and 90"""
)
def series_json_explode(spark, sf_dir):
    """Curves as JSON cells, exploded to points again and held against their attributes' ranges."""
    pts = events_curve(spark, sf_dir).groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    cell = F.to_json(F.struct(F.lit("rank").alias("x_attr"), F.lit("value").alias("y_attr"), F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    ranges = spark.createDataFrame([("rank", 2.0, 40.0), ("value", 1.0, 90.0)], "attr string, low double, high double")
    points = curves.series_points(pts.select("curve", cell.alias("series")))
    return curves.within_bounds(points, F.broadcast(ranges)).select("curve", "x_attr", "y_attr", "x", "y")


@query(
    """select user_id, case when hi - lo > 0.3 * abs(hi) then printf('%.2f-%.2f', lo, hi) else printf('%.2f', hi) end as span
from (select user_id, min(value) as lo, max(value) as hi from events group by 1)"""
)
def series_value_span(spark, sf_dir):
    return curves.value_span(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", "span")


@query(
    """with lab as (select p_partkey, p_retailprice as pos, p_size as axis from part),
tick as (select distinct p_size as axis, cast(g as double) * 40 as tick from part, range(0, 60) t(g))
select p_partkey, arg_min(tick, (abs(pos - tick), tick)) as tick from lab join tick using (axis) where abs(pos - tick) <= 15 group by p_partkey"""
)
def label_nearest_tick(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    labels = part.select("p_partkey", F.col("p_retailprice").alias("pos"), F.col("p_size").alias("axis"))
    grid = part.select(F.col("p_size").alias("axis")).distinct().withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("tick", F.col("tick").cast("double") * 40)
    return band.nearest_within(labels, grid, ["axis"], ["p_partkey"], "pos", "tick", 15.0, "tick").select("p_partkey", "tick")


@query(
    """with e as (select user_id, event_type, event_id, row_number() over (partition by user_id order by ts, event_id) as pos from events)
select a.user_id, count(*) filter (abs(a.pos - b.pos) <= 15) as strong, count(*) filter (abs(a.pos - b.pos) > 15) as weak
from e a join e b on a.user_id = b.user_id and abs(a.pos - b.pos) <= 45 where a.event_type = 'click' and b.event_type <> 'click' group by 1"""
)
def proximity_pairs(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", pos.alias("pos"))
    hits, measured = ev.filter("event_type = 'click'"), ev.filter("event_type <> 'click'").withColumnRenamed("pos", "mpos").drop("event_type")
    pairs = band.band_join(hits, measured, ["user_id"], "pos", "mpos", 45)
    near = F.abs(F.col("pos") - F.col("mpos")) <= 15
    return pairs.groupBy("user_id").agg(F.count_if(near).alias("strong"), F.count_if(~near).alias("weak"))


@query(
    """with e as (select event_type as axis, event_id % 500 as pos, event_id from events),
c as (select a.axis, a.event_id, count(*) as n from e a join e b on a.axis = b.axis and abs(a.pos - b.pos) < 15 group by 1, 2)
select axis, max(n) as most, max(n) >= 3 as aligned from c group by axis"""
)
def aligned_ticks(spark, sf_dir):
    """Ticks within 15 pixels of a tick: a range frame instead of a self join."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("axis"), (F.col("event_id") % 500).alias("pos"))
    at = rows.groupBy("axis", "pos").agg(F.count(F.lit(1)).alias("here"))  # a row for each position, not for each tick
    near = F.sum("here").over(Window.partitionBy("axis").orderBy("pos").rangeBetween(-14, 14))
    return at.withColumn("n", near).groupBy("axis").agg(F.max("n").alias("most"), (F.max("n") >= 3).alias("aligned"))


@query()
def curve_smoothing(spark, sf_dir):
    return curves.smoothed(events_curve(spark, sf_dir).select("curve", "x", "y"), "curve")


@query(
    f"""with {CURVE} select curve, var_pop(y) * count(*) * 0.5 as smoothing, count(*) as n from p group by curve having count(*) > 3"""
)
def smoothing_factor(spark, sf_dir):
    pts = events_curve(spark, sf_dir).groupBy("curve").agg((F.var_pop("y") * F.count(F.lit(1)) * 0.5).alias("smoothing"), F.count(F.lit(1)).alias("n"))
    return pts.filter("n > 3")
