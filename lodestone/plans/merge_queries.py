"""Queries of the merge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import merge
from lodestone.plans.registry import query, table

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

CANDIDATES = """
c as (
  select l_orderkey as file, l_returnflag as attr,
    case l_linenumber % 3 when 0 then 'table' when 1 then 'plot' else 'text' end as source,
    cast(cast(l_quantity as bigint) as varchar) as value, 0.9 + abs(l_discount) as confidence,
    'line ' || l_linenumber || ' part ' || l_partkey as proof, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  from lineitem),
r as (
  select *, case source when 'table' then 1 when 'plot' then 2 else 3 end as priority from c),
k as (
  select *, row_number() over w as rank, lead(value) over w as runner_up from r
  window w as (partition by file, attr order by priority, confidence desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice))
"""


def candidates(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    turn = F.col("l_linenumber") % 3
    return line.select(
        F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("attr"),
        F.when(turn == 0, "table").when(turn == 1, "plot").otherwise("text").alias("source"),
        F.col("l_quantity").cast("long").cast("string").alias("value"), (0.9 + F.abs("l_discount")).alias("confidence"),
        F.concat(F.lit("line "), "l_linenumber", F.lit(" part "), "l_partkey").alias("proof"), *ORDER,
    )


@query(
    f"""with {CANDIDATES},
best as (
  select *, case when (confidence >= 0.95 or source = 'table') and coalesce(lower(runner_up) = lower(value), true) then value end as kept
  from k where rank = 1),
proofs as (select file, string_agg(proof, ' | ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, proof) as proof from c group by file)
select b.file,
  coalesce(max(kept) filter (attr = 'A'), '') as "A", coalesce(max(kept) filter (attr = 'N'), '') as "N", coalesce(max(kept) filter (attr = 'R'), '') as "R",
  any_value(p.proof) as proof,
  concat_ws(', ', max('A←' || source) filter (attr = 'A'), max('N←' || source) filter (attr = 'N'), max('R←' || source) filter (attr = 'R')) as source_summary
from best b join proofs p on b.file = p.file where kept is not null group by b.file"""
)
def consolidate_best_source(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return merge.wide(merge.consolidate(rows, ORDER), merge.joined_proofs(rows, ORDER), ["A", "N", "R"])


@query(f"with {CANDIDATES} select file, attr, value, runner_up from k where rank = 1 and lower(runner_up) <> lower(value)")
def conflict_rejected_cells(spark, sf_dir):
    best = merge.ranked(candidates(spark, sf_dir), ORDER).filter("rank = 1 and lower(runner_up) <> lower(value)")
    return best.select("file", "attr", "value", "runner_up")


@query(f"with {CANDIDATES} select file, attr, value, source, confidence as conf from k where rank = 1")
def best_candidate_without_veritas(spark, sf_dir):
    return merge.consolidate(candidates(spark, sf_dir), ORDER, veritas=False)


@query(
    """select source, count(*) as n, count(value) as with_value, count(unit) as with_unit from (
  select 'table' as source, cast(l_quantity as bigint) as value, null as unit from lineitem where l_linenumber % 3 = 0
  union all select 'plot', cast(l_quantity as bigint), l_returnflag from lineitem where l_linenumber % 3 = 1
  union all select 'text', null, l_linestatus from lineitem where l_linenumber % 3 = 2) group by source"""
)
def union_tagged_sources(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part = lambda i: line.filter(F.col("l_linenumber") % 3 == i)
    value = F.col("l_quantity").cast("long").alias("value")
    frames = {"table": part(0).select(value), "plot": part(1).select(value, F.col("l_returnflag").alias("unit")), "text": part(2).select(F.col("l_linestatus").alias("unit"))}
    return merge.union_sources(frames).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.count("unit").alias("with_unit"))


@query(
    """select cast(o_orderkey as varchar) as file, o_orderpriority as "A", '' as x_value from orders
union select cast(l_orderkey as varchar), '', cast(l_linenumber as varchar) from lineitem"""
)
def append_points_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderpriority").alias("A"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("string").alias("x_value"))
    return merge.append_points(rows, points).select("file", "A", "x_value")


@query(
    """with r as (select o_orderkey as file, case when o_orderstatus = 'O' then '' when o_orderstatus = 'P' then 'nan' else o_orderstatus end as a,
  case when o_orderkey % 3 = 0 then null else o_orderpriority end as b from orders)
select file, a, b from r where not (a is null or trim(a) in ('', 'nan', 'None')) or not (b is null or trim(b) in ('', 'nan', 'None'))"""
)
def drop_blank_rows(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"),
        F.when(status == "O", "").when(status == "P", "nan").otherwise(status).alias("a"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("b"),
    )
    return merge.drop_blank(rows, ["a", "b"])


@query(f"with {CANDIDATES} select source, count(*) as total, count(*) filter (rank = 1) as best, count(distinct file) as files from k group by source")
def run_totals(spark, sf_dir):
    rows = merge.ranked(candidates(spark, sf_dir), ORDER)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rank") == 1).alias("best"), F.countDistinct("file").alias("files"))


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def exact_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("select o_orderkey, o_custkey, coalesce(nullif(o_orderpriority, '1-URGENT'), '') as priority from orders order by o_orderkey limit 1000")
def top_k_preview(spark, sf_dir):
    """The preview of a result: a limit is the feature."""
    rows = table(spark, sf_dir, "orders").withColumn("priority", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")))
    return rows.na.fill("", ["priority"]).orderBy("o_orderkey").limit(1000).select("o_orderkey", "o_custkey", "priority")


@query("select o_custkey as value, o_totalprice as price from orders")
def shown_columns(spark, sf_dir):
    """Results without names of files, flags and reasons."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return merge.shown_columns(orders.select(F.col("o_orderkey").alias("File"), status.alias("source"), F.col("o_custkey").alias("value"), F.col("o_totalprice").alias("price"), status.alias("value_flag"), status.alias("price_reasons_all")))
