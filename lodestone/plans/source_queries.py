"""Queries of sources, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lodestone.operators import pages
from lodestone.sources import engines, files
from lodestone.streaming import events
from lodestone.plans.registry import query, table


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    return f"{base.rstrip('/')}/lodestone/{uuid.uuid4().hex}"


@query(
    """select p_name as title, 'A, B' as authors, '2020' as year, 'arXiv' as journal, case when p_partkey % 2 = 0 then '10.1/' || p_partkey end as doi, 'http://x/' || p_partkey || '.pdf' as pdf from part"""
)
def scan_arxiv(spark, sf_dir):
    entry = F.concat(
        F.lit("<entry><title>"), "p_name", F.lit("</title><published>2020-01-02</published><author><name>A</name></author><author><name> B </name></author>"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<arxiv:doi>10.1/"), "p_partkey", F.lit("</arxiv:doi>"))).otherwise(F.lit("")),
        F.lit('<link title="pdf" href="http://x/'), "p_partkey", F.lit('.pdf"/></entry>'),
    )
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(entry), "").alias("e"))
    return engines.arxiv(rows.select(F.concat(F.lit("<feed><title>all</title>"), "e", F.lit("</feed>")).alias("payload")))


@query(
    """select p_name as title, 'A, B' as authors, cast(2000 + p_size as varchar) as year, p_brand as journal, '10.1/' || p_partkey as doi, case when p_partkey % 2 = 0 then 'http://x/' || p_partkey end as pdf from part"""
)
def scan_semantic_scholar(spark, sf_dir):
    names = F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit("B").alias("name")))
    item = F.struct(
        F.col("p_name").alias("title"), (2000 + F.col("p_size")).alias("year"), F.col("p_brand").alias("venue"), names.alias("authors"),
        F.struct(F.concat(F.lit("10.1/"), "p_partkey").alias("DOI")).alias("externalIds"),
        F.struct(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://x/"), "p_partkey")).alias("url")).alias("openAccessPdf"),
    )
    reply = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    return engines.semantic_scholar(reply)


@query(
    """select p_name as title, 'A' as authors, '2001' as year, p_brand as journal, '10.1/' || p_partkey as doi, 'https://europepmc.org/articles/PMC' || p_partkey || '?pdf=render' as pdf from part where p_partkey % 3 = 0"""
)
def scan_europepmc(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.struct(
        F.col("p_name").alias("title"), F.lit("A").alias("authorString"), F.lit("2001").alias("pubYear"), F.col("p_brand").alias("journalTitle"), F.concat(F.lit("10.1/"), key).alias("doi"),
        F.concat(F.lit("PMC"), key).alias("pmcid"), F.when(key % 3 == 0, "Y").otherwise("N").alias("isOpenAccess"),
    )
    reply = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("result")).alias("resultList"))).alias("payload"))
    return engines.europepmc(reply)


@query(
    """select p_name as title, 'G F' as authors, cast(1990 + p_size as varchar) as year, p_brand as journal, '10.1/' || p_partkey as doi, case when p_partkey % 2 = 0 then 'http://b/' || p_partkey end as pdf from part"""
)
def scan_crossref(spark, sf_dir):
    key = F.col("p_partkey")
    kind = F.when(key % 2 == 0, "application/pdf").otherwise("text/xml")
    links = F.array(F.struct(F.lit("http://a").alias("URL"), F.lit("text/html").alias("content-type")), F.struct(F.concat(F.lit("http://b/"), key).alias("URL"), kind.alias("content-type")))
    item = F.struct(
        F.array("p_name").alias("title"), F.array(F.struct(F.lit("G").alias("given"), F.lit("F").alias("family"))).alias("author"), F.array("p_brand").alias("container-title"),
        F.concat(F.lit("10.1/"), key).alias("DOI"), F.struct(F.array(F.array(1990 + F.col("p_size"))).alias("date-parts")).alias("issued"), links.alias("link"),
    )
    reply = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("message"))).alias("payload"))
    return engines.crossref(reply)


@query("select p_name as title, 'A' as authors, '2011' as year, p_brand as journal, '10.1/' || p_partkey as doi, 'http://c/' || p_partkey as pdf from part where p_partkey % 4 <> 0")
def scan_core(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.struct(
        F.col("p_name").alias("title"), F.array(F.struct(F.lit("A").alias("name"))).alias("authors"), F.lit(2011).alias("yearPublished"), F.col("p_brand").alias("publisher"),
        F.concat(F.lit("10.1/"), key).alias("doi"), F.when(key % 4 != 0, F.concat(F.lit("http://c/"), key)).alias("downloadUrl"),
    )
    reply = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("payload"))
    return engines.core(reply)


@query("select p_name as title, null::varchar as authors, '1999' as year, null::varchar as journal, null::varchar as doi, case when p_partkey % 2 = 0 then 'http://d/' || p_partkey || '.pdf' end as pdf from part")
def scan_scholar_html(spark, sf_dir):
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<a href="http://d/'), "p_partkey", F.lit('.pdf">pdf</a>'))).otherwise(F.lit(""))
    item = F.concat(F.lit('<div class="gs_r gs_or"><h3><a>'), "p_name", F.lit("</a></h3> - 1999 - "), link, F.lit("</div>"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(item), "").alias("payload"))
    return engines.scholar_html(rows)


@query("select cast(r_regionkey as varchar) as key, r_name as name, 'table' as _source from region")
def csv_round_trip(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))
    files.write_csv(rows, path, ["key"])
    return files.tagged_csv(spark, path, "table")


@query("select cast(n_nationkey as varchar) as file, n_nationkey % 2 = 0 as include, n_nationkey / 10.0 as score, n_name as term from nation")
def nested_json_round_trip(spark, sf_dir):
    path = _folder(spark)
    hit = F.struct(F.col("n_name").alias("term"), F.lit(None).cast("string").alias("attribute"), F.lit("primary").alias("strength"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("file"), (F.col("n_nationkey") % 2 == 0).alias("include"), (F.col("n_nationkey") / 10.0).alias("score"), F.array(hit).alias("keyword_hits"))
    files.write_nested(rows, path)
    return files.screening_json(spark, path).select("file", "include", "score", F.explode("keyword_hits.term").alias("term"))


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0 union all select o_orderkey, null from orders where o_orderkey % 2 = 1")
def progressive_append(spark, sf_dir):
    path = _folder(spark)
    orders = table(spark, sf_dir, "orders")
    files.append_rows(orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), path)
    files.append_rows(orders.filter("o_orderkey % 2 = 1").select("o_orderkey"), path)
    return spark.read.option("mergeSchema", True).parquet(path).select("o_orderkey", "o_orderstatus")


@query(
    """select 'f' || user_id as "File", event_type as "Series_Name", cast(event_id as double) as "X_Value", value as "Y_Value" from events"""
)
def digitized_points(spark, sf_dir):
    point = F.struct(F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    series = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("f"), "user_id").alias("File"), F.col("event_type").alias("Series_Name")).agg(F.collect_list(point).alias("points"))
    return files.digitized_points(series).select("File", "Series_Name", "X_Value", "Y_Value")


@query("select 'f' || c_custkey as \"File\", 'WARN' as \"Severity\", 'not a number: ' || c_name as \"Message\" from customer where c_custkey % 3 = 0")
def error_log(spark, sf_dir):
    cell = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("File"), cell.alias("value"))
    return files.split_errors(rows, "value")[1]


@query("select distinct o_custkey as \"File\" from orders where o_custkey is not null")
def cited_files(spark, sf_dir):
    return files.cited_files(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "File"))


@query(
    """select doc_id, (sum(case when page <= 2 then length(trim(substr(text, (page - 1) * 1000 + 1, 1000))) else 0 end) > 50) or count(*) >= 4 as valid
from (select doc_id, text, unnest(range(1, greatest(1, cast(ceil(length(text) / 1000.0) as bigint)) + 1)) as page from documents) group by doc_id"""
)
def valid_documents(spark, sf_dir):
    return engines.valid_document(pages.pages(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def streaming_dedup(spark, sf_dir):
    """A stream of events, each (user, type) once within a watermark that spans the table."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.deduplicated(stream, ["user_id", "event_type"], "ts", "3650 days")
    return events.drain(once.select("user_id", "event_type", "ts"), _folder(spark)).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, sum(value) as total from events group by all")
def event_windows(spark, sf_dir):
    """Tumbling windows of a day; the same function runs on a stream."""
    out = events.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query(
    """with e as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as s from events window w as (partition by user_id order by ts)),
g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, count(*) as n from g group by user_id, k"""
)
def event_sessions(spark, sf_dir):
    out = events.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


@query(
    """select user_id, date_trunc('day', ts::timestamp) as day, count(*) as n, round(sum(event_id), 3)::double as total from events group by all"""
)
def windowed_stream(spark, sf_dir):
    """Daily windows by user as a stream; the watermark spans the table and ends with it, so complete mode returns all."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    made = events.windowed(stream, "ts", "user_id", "event_id", "1 day", None, "3650 days")
    rows = events.drain_complete(made.select("user_id", F.col("window.start").alias("day"), "n", "total"), _folder(spark))
    return rows.select("user_id", F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round(F.col("total").cast("double"), 3).alias("total"))


@query(
    """select p_type as attribute, row_number() over (order by p_type) - 1 as ordinal, min(p_brand) as alias, 'F/g' as unit, min(p_size)::double as low, max(p_size)::double as high from part group by p_type"""
)
def aliases_round_trip(spark, sf_dir):
    """A schema as one JSON object, attributes in its order."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_brand").alias("a"), F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    entry = F.struct(F.array("a").alias("aliases"), F.array(F.lit("F/g")).alias("units"), F.array("lo", "hi").alias("range"))
    made = part.select("p_type", F.to_json(entry).alias("j")).agg(F.array_sort(F.collect_list(F.struct("p_type", "j"))).alias("e"))
    pairs = F.transform("e", lambda x: F.concat(F.lit('"'), x["p_type"], F.lit('": '), x["j"]))
    made.select(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    rows = files.aliases_json(spark, path).filter(F.col("attribute").isNotNull())
    return rows.select("attribute", F.col("ordinal").cast("long").alias("ordinal"), F.get("aliases", F.lit(0)).alias("alias"), F.get("units", F.lit(0)).alias("unit"), "low", "high")


@query("select cast(o_orderkey as varchar) as file, p as page from (select o_orderkey, unnest([o_orderkey % 7, o_orderkey % 7 + 3]) as p from orders)")
def routing_round_trip(spark, sf_dir):
    """Pages routed to each extractor, a JSON object a line."""
    path = _folder(spark)
    key = (F.col("o_orderkey") % 7).cast("int")
    files.write_nested(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.array(key, key + 3).alias("tables_pages"), F.array(key).alias("plots_pages")), path)
    return files.routing_json(spark, path).select("file", F.explode("tables_pages").alias("page")).select("file", F.col("page").cast("long").alias("page"))


@query("select 'f' || r_regionkey as File, n_nationkey % 3 as Image_ID, n_nationkey::double as x, r_name as name from nation join region on n_regionkey = r_regionkey")
def panel_files(spark, sf_dir):
    """One folder of JSON points per panel."""
    path = _folder(spark)
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files.write_panels(both.select(F.concat(F.lit("f"), "r_regionkey").alias("File"), (F.col("n_nationkey") % 3).alias("Image_ID"), F.col("n_nationkey").cast("double").alias("x"), F.col("r_name").alias("name")), path)
    return spark.read.schema("x double, name string, File string, Image_ID long").json(path).select("File", "Image_ID", "x", "name")
