"""Queries of candidates, tables, matching and acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import acquisition, candidates, matching, tables
from lodestone.plans.registry import query, table

KEY = "l_partkey, l_suppkey, l_extendedprice"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


SCORED = f"""c as (select l_orderkey as file, l_returnflag as attr, l_quantity as value, 100 * l_discount + l_linenumber as score, l_linenumber as location, {KEY} from lineitem),
t as (select *, max(score) over (partition by file, attr) as top from c),
r as (select *, row_number() over (partition by file, attr order by case when attr = 'R' then value else score end desc, location, {KEY}) as n from t where attr <> 'R' or score >= greatest(0.8 * top, top - 50))"""


def _scored(spark, sf_dir):
    line = _lines(spark, sf_dir)
    return line.select(
        F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("attr"), F.col("l_quantity").alias("value"),
        (100 * F.col("l_discount") + F.col("l_linenumber")).alias("score"), F.col("l_linenumber").alias("location"), "l_partkey", "l_suppkey", "l_extendedprice",
    )


@query(f"with {SCORED} select file, attr, value, score from r where n = 1")
def max_value_candidate(spark, sf_dir):
    best = candidates.best_or_largest(_scored(spark, sf_dir), ["location", "l_partkey", "l_suppkey", "l_extendedprice"], ["R"])
    return best.select("file", "attr", "value", "score")


@query(
    f"""with {SCORED}, b as (select file, attr, value, location, row_number() over (partition by file, value, location order by case attr when 'A' then 0 when 'N' then 1 else 2 end) as k from r where n = 1)
select file, attr, value from b where k = 1"""
)
def one_value_one_attr(spark, sf_dir):
    best = candidates.best_or_largest(_scored(spark, sf_dir), ["location", "l_partkey", "l_suppkey", "l_extendedprice"], ["R"])
    ordinal = F.when(F.col("attr") == "A", 0).when(F.col("attr") == "N", 1).otherwise(2)
    return candidates.one_attribute_per_value(best.withColumn("attr_ordinal", ordinal)).select("file", "attr", "value")


@query()
def greedy_matching(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("attr"), F.col("l_quantity").alias("number"), (100 * F.col("l_discount")).alias("score"),
        F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return candidates.greedy_matching(rows)


CELLS = """c as (select l_orderkey as t, l_linenumber as row, l_partkey % 3 as col, min(case when (l_linenumber < 3 and l_orderkey % 4 > 0) or l_suppkey % 5 = 0 then 'name ' || l_returnflag else cast(cast(l_quantity as bigint) as varchar) end) as cell
  from (select *, l_linenumber from lineitem) group by 1, 2, 3)"""


def _cells(spark, sf_dir):
    line = _lines(spark, sf_dir)
    texty = ((F.col("l_linenumber") < 3) & (F.col("l_orderkey") % 4 > 0)) | (F.col("l_suppkey") % 5 == 0)
    cell = F.when(texty, F.concat(F.lit("name "), "l_returnflag")).otherwise(F.col("l_quantity").cast("long").cast("string"))
    return line.groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 3).alias("col")).agg(F.min(cell).alias("cell"))


HEADERS = f"""{CELLS}, x as (select t, row, case when count(*) filter (not regexp_matches(cell, '[0-9]') and trim(cell) <> '') > count(*) filter (regexp_matches(cell, '[0-9]')) then 1 else 0 end as texty from c where row < 5 group by 1, 2),
h as (select t, cast(sum(s) as bigint) as n_header from (select *, min(texty) over (partition by t order by row) as s from x) group by t)"""


@query(f"with {HEADERS} select t, n_header from h")
def header_boundary(spark, sf_dir):
    return tables.header_rows(_cells(spark, sf_dir), "t")


@query(
    f"""with {HEADERS} select t, col, array_to_string(list(cell order by row, cell)[1:3], '|') as samples from c join h using (t) where row >= n_header and row < n_header + 5 and trim(cell) <> '' group by 1, 2"""
)
def header_samples(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    out = tables.sample_values(cells, tables.header_rows(cells, "t"), "t")
    return out.select("t", "col", F.array_join("samples", "|").alias("samples"))


@query(
    f"""with {CELLS}, a(col, attribute) as (values (0, 'capacity'), (2, 'voltage'))
select t, row, attribute, cell from c join a using (col) where length(cell) <= 50 and regexp_matches(cell, '[0-9]')"""
)
def attributed_cells(spark, sf_dir):
    """Cells meet their column's attribute by position; only short cells with a digit count as values."""
    cells = _cells(spark, sf_dir)
    keys = cells.select("t").distinct()
    attrs = keys.withColumn("a", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("col"), F.lit("capacity").alias("attribute")), F.struct(F.lit(2).cast("long").alias("col"), F.lit("voltage").alias("attribute"))))).select("t", "a.*")
    found = tables.attributed_cells(cells, attrs, "t").filter(tables.is_value_cell(F.col("cell")))
    return found.select("t", "row", "attribute", "cell")


ALIASES = [("steel", "metal"), ("polished brass", "metal"), ("red", "colour"), ("gold metallic", "finish"), ("copper", "metal"), ("large anvil", "shape")]
ALIAS_SQL = "a(alias, attribute, ordinal) as (values " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(ALIASES)) + ")"


def _aliases(spark):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(ALIASES)], "alias string, attribute string, ordinal int")


@query(
    f"""with {ALIAS_SQL}, n as (select p_partkey, lower(p_name) || ' ' || lower(p_type) as name from part),
s as (select p_partkey, attribute, ordinal, (select count(distinct w) from unnest(string_split(alias, ' ')) t(w) where length(w) > 3 and list_contains(string_split(trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')), ' '), w))
  / nullif((select count(distinct w) from unnest(string_split(alias, ' ')) t(w) where length(w) > 3), 0) as match from n, a),
b as (select p_partkey, arg_max(attribute, (coalesce(match, 0), -ordinal)) as attribute, max(coalesce(match, 0)) as match from s group by 1)
select p_partkey, case when match >= 0.5 then attribute end as attribute, match::double as match from b"""
)
def attribute_fuzzy_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return matching.fuzzy_alias(names, "name", _aliases(spark)).select("p_partkey", "attribute", "match")


@query(
    f"""with {ALIAS_SQL}, n as (select p_partkey, lower(p_name || ' ' || p_type) as name from part)
select n.p_partkey, arg_max(a.attribute, (length(alias) / length(name), -ordinal)) as attribute, max(length(alias) / length(name)) as match from n left join a on contains(name, alias) group by 1"""
)
def header_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return matching.header_match(names, "name", _aliases(spark)).select("p_partkey", "attribute", "match")


@query(
    f"""with {ALIAS_SQL}, n as (select p_partkey, lower(p_name || ' ' || p_type) as name, case when p_size > 25 then 'metal' when p_size < 10 then 'colour' end as owner from part)
select n.p_partkey, arg_max(a.attribute, (length(alias), -ordinal)) as attribute
from n left join a on (case when length(alias) <= 3 then list_contains(string_split_regex(name, '[^a-z0-9]+'), alias) else contains(name, alias) or (len(list_filter(string_split(alias, ' '), lambda w: length(w) > 3)) > 0
  and len(list_filter(string_split(alias, ' '), lambda w: length(w) > 3 and not contains(name, w))) = 0) end) and coalesce(owner = a.attribute, true) group by 1"""
)
def axis_attr_match(spark, sf_dir):
    unit = F.when(F.col("p_size") > 25, "KG").when(F.col("p_size") < 10, "nm").otherwise("other")
    axes = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"), unit.alias("axis_unit"))
    owners = spark.createDataFrame([("kg", "metal"), ("nm", "colour")], "unit string, owner string")
    return matching.axis_match(axes, "title", "axis_unit", _aliases(spark), owners).select("p_partkey", "attribute")


@query(
    """with a(k, attribute) as (values ('red steel', 'r'), ('blue bolt', 'b')) select p_partkey, attribute from part left join a on trim(regexp_replace(lower(replace(p_name, ' ', '_') ), '[^a-z0-9]+', ' ', 'g')) = k"""
)
def alias_lookup(spark, sf_dir):
    aliases = spark.createDataFrame([("Red-Steel", "r", 0), ("red steel", "never", 1), ("blue_bolt", "b", 2)], "alias string, attribute string, ordinal int")
    names = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return matching.exact_alias(names, "name", aliases).select("p_partkey", "attribute")


@query("select s_suppkey, case s_nationkey % 3 when 0 then 'energy' when 1 then 'power' end as attribute from supplier")
def first_attribute_of_unit(spark, sf_dir):
    owners = spark.createDataFrame([("wh/kg", "energy", 0), ("wh/kg", "later", 3), ("w/kg", "power", 1)], "unit string, attribute string, ordinal int")
    unit = F.when(F.col("s_nationkey") % 3 == 0, "wh/kg").when(F.col("s_nationkey") % 3 == 1, "w/kg").otherwise("nm")
    return matching.first_attribute_of(table(spark, sf_dir, "supplier").withColumn("u", unit), "u", owners, "unit").select("s_suppkey", "attribute")


@query(
    """with v as (select vec_id, cast(floor(abs(embedding[1]) * 1800) as bigint) % 180 as hue from embeddings), c(curve, h) as (values (0, 10), (1, 40), (2, 75), (3, 110), (4, 150), (5, 176))
select vec_id, arg_min(curve, (least(abs(hue - h), 180 - abs(hue - h)), curve)) as curve from v, c where least(abs(hue - h), 180 - abs(hue - h)) < 15 group by vec_id"""
)
def legend_hue_match(spark, sf_dir):
    """The curve whose hue is nearest a legend's, within 15 on the circle."""
    from lodestone.functions.geometry import circular_distance

    hue = F.floor(F.abs(F.element_at("embedding", 1)) * 1800) % 180
    legends = table(spark, sf_dir, "embeddings").select("vec_id", hue.alias("hue"))
    curves = F.array(*[F.struct(F.lit(i).alias("curve"), F.lit(h).alias("h")) for i, h in enumerate((10, 40, 75, 110, 150, 176))])
    near = F.filter(curves, lambda c: circular_distance(F.col("hue"), c["h"]) < 15)
    best = F.array_min(F.transform(near, lambda c: F.struct(circular_distance(F.col("hue"), c["h"]).alias("d"), c["curve"].alias("curve"))))
    return legends.select("vec_id", best["curve"].alias("curve")).filter("curve is not null")


@query(
    """with k as (select doc_id, regexp_replace(lower(text), '[^a-z0-9_]+', '', 'g') as t from documents),
fresh as (select * from k where doc_id % 2 = 1 and t not in (select t from k where doc_id % 2 = 0))
select min(doc_id) as doc_id from fresh group by t"""
)
def title_dedup(spark, sf_dir):
    """The whole normalised text is the key and every document takes part: odd ids are found, even ones stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("doi"))
    found, stored = docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0")
    return acquisition.new_papers(found, stored, ["doc_id"]).select("doc_id")


@query(
    """with e as (select 0 as engine_rank, o_orderkey as id, (o_orderkey % 100) / 100.0 as score from orders where o_orderkey % 2 = 0 union all select 1, o_orderkey, (o_orderkey % 100) / 100.0 from orders where o_orderkey % 2 = 1)
select engine_rank, id, score::double as relevance_score from e where score >= 0.35 order by engine_rank, id limit 200"""
)
def federated_scan(spark, sf_dir):
    """Every order belongs to one of two engines, asked in order of priority until enough papers pass the gate: the limit is the feature."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 100) / 100.0).alias("relevance_score"))
    found = acquisition.federated({"first": orders.filter("id % 2 = 0"), "second": orders.filter("id % 2 = 1")}, ["id"])
    return acquisition.accepted(found, 0.35, 200, ["engine_rank", "id"]).select("engine_rank", "id", "relevance_score")


@query("select p_brand as brand, arg_min(p_name, p_partkey) as phrase from (select *, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as n from part) group by p_brand, lower(n)")
def distinct_phrases(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("n", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return acquisition.distinct_phrases(rows, "p_brand", "n", "p_partkey").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("phrase"))


@query("select event_id from events where ts < (select max(ts) from events) - interval 7 days")
def ttl_filter(spark, sf_dir):
    return acquisition.expired(table(spark, sf_dir, "events"), "ts").select("event_id")


@query(
    """with u as (select page_id, [url || '.pdf', 'http://arxiv.org/' || page_id, 'https://doi.org/x' || page_id, url, url || '.pdf'] as urls from pages),
x as (select distinct page_id, unnest(urls) as u from u)
select page_id, string_agg(u, ' ' order by case when contains(lower(u), 'arxiv.org') then 0 when contains(lower(u), 'europepmc') or contains(lower(u), 'ncbi.nlm') then 1 when regexp_matches(lower(u), '\\.pdf($|[?#])') then 2 when contains(lower(u), 'doi.org') then 4 else 3 end, u) as ordered from x group by 1"""
)
def url_priorities(spark, sf_dir):
    p, u = F.col("page_id").cast("string"), F.col("url")
    urls = F.array(F.concat(u, F.lit(".pdf")), F.concat(F.lit("http://arxiv.org/"), p), F.concat(F.lit("https://doi.org/x"), p), u, F.concat(u, F.lit(".pdf")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tx.ordered_urls(urls), " ").alias("ordered"))


@query(
    r"""select page_id, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>')) as items, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as heading from pages"""
)
def html_items(spark, sf_dir):
    """List items and headings of raw pages, as a scraper reads them."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_count("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>")).cast("long").alias("items"), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading")
    )


@query("select conv_id, turn, cast(floor(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) * 1.3) as bigint) as tokens, string_split(role || ' → ' || turn, ' → ')[1] as location from conversations")
def estimated_tokens(spark, sf_dir):
    proof = F.concat("role", F.lit(" → "), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.estimated_tokens(F.col("text")).alias("tokens"), tx.proof_location(proof).alias("location"))


@query(
    """select p_partkey, (case when p_partkey % 2 = 0 then 200 else 0 end) - (case when p_partkey % 7 = 0 then 1000 else 0 end) + case p_partkey % 3 when 0 then 100 when 1 then 20 else 0 end as score from part"""
)
def legacy_scores(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 3 == 0, "the Pore Volume was ").when(k % 3 == 1, "a volume of ").otherwise("it was "), F.col("p_size"))
    score = candidates.legacy_score(line, F.lit(5), F.lit("pore volume"), k % 2 == 0, k % 7 == 0)
    rows = table(spark, sf_dir, "part").withColumn("p", F.lit(1))
    return rows.select("p_partkey", score.alias("score"))
