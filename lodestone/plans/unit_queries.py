"""Queries of units, values, validation and cells. Their inputs are strings made of lineitem and part columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text, units, validation
from lodestone.plans.registry import query, table

UNITS = ["F g-1", " wh kg-1", "W/kg", "A g⁻1", "mAh/g", "m2 g-1", "ohm", "nm", "mf cm-2", "Hz"]
DIMENSIONED = ["F/g", "Wh kg-1", "W/kg", "mA/g", "nm", "m²/g", "°C", "kv", "min", "parsec"]


def _sql_list(items):
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _pick(col, items):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(col, F.lit(len(items))) + 1).cast("int"))


def _pick_sql(col, items):
    return f"({_sql_list(items)})[{col} % {len(items)} + 1]"


_VARIANTS_SQL = "map {" + ", ".join(f"'{v}': '{c}'" for c, vs in units.VARIANTS.items() for v in vs) + "}"


@query(
    f"""with u as (select l_orderkey, l_linenumber, l_partkey, {_pick_sql('l_partkey', UNITS)} as unit from lineitem)
select unit, translate(lower(trim(unit)), '−⁻', '--') as flat, coalesce({_VARIANTS_SQL}[translate(lower(trim(unit)), '−⁻', '--')], lower(trim(unit))) as canonical, count(*) as n
from u group by all"""
)
def unit_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(_pick(F.col("l_partkey"), UNITS).alias("unit"))
    flat = F.translate(F.lower(F.trim("unit")), "−⁻", "--").alias("flat")
    return rows.select("unit", flat, units.normalize_unit(F.col("unit")).alias("canonical")).groupBy("unit", "flat", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with f(unit, dimension, factor, off, base_unit) as (values ('F/g', 'capacitance_per_mass', 1000.0, 0.0, 'F/kg'), ('Wh kg-1', 'energy_per_mass', 3600.0, 0.0, 'J/kg'),
  ('W/kg', 'power_per_mass', 1.0, 0.0, 'W/kg'), ('mA/g', 'current_per_mass', 1.0, 0.0, 'A/kg'), ('nm', 'length', 1e-9, 0.0, 'm'), ('m²/g', 'area_per_mass', 1000.0, 0.0, 'm²/kg'),
  ('°C', 'temperature', 1.0, 273.15, 'K'), ('kv', 'voltage', 1000.0, 0.0, 'V'), ('min', 'time', 60.0, 0.0, 's'))
select l_orderkey, l_linenumber, l_partkey, l_quantity, {_pick_sql('l_partkey', DIMENSIONED)} as unit, dimension, round(l_quantity * factor + off, 9) as base_value, base_unit
from lineitem left join f on f.unit = {_pick_sql('l_partkey', DIMENSIONED)}"""
)
def unit_convert(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("unit", _pick(F.col("l_partkey"), DIMENSIONED))
    found = units.with_dimension(rows, "unit")
    value = F.round(units.to_base(F.col("l_quantity"), F.col("factor"), F.col("offset")), 9)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "unit", "dimension", value.alias("base_value"), "base_unit")


@query(
    """select p_partkey, form, case form when 0 then value when 1 then value + 5 when 2 then value when 3 then value / 1000 else value end as value,
  case form when 0 then 1.0 when 1 then 0.7 when 2 then 0.8 when 3 then 1.0 else 0.4 end::double as confidence,
  case form when 0 then 'single' when 1 then 'range' when 2 then 'with_error' when 3 then 'single' else 'extracted' end as value_type
from (select p_partkey, p_partkey % 5 as form, cast(p_size as double) as value from part)"""
)
def parse_values(spark, sf_dir):
    """The five written forms of a value; the SQL knows what was written."""
    n, form = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    written = (
        F.when(form == 0, n).when(form == 1, F.concat(n, F.lit(" – "), (F.col("p_size") + 10).cast("string")))
        .when(form == 2, F.concat(n, F.lit(" ± 0.3"))).when(form == 3, F.concat(n, F.lit("e-3"))).otherwise(F.concat(F.lit("about "), n, F.lit(" of them")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", form.alias("form"), units.parse_value(written).alias("v"))
    return rows.select("p_partkey", "form", "v.value", "v.confidence", "v.value_type")


@query(
    """select p_partkey, case p_partkey % 6 when 0 then p_size || ' f/g' when 1 then null when 2 then null when 3 then (case when p_size <= 40 then p_size || ' f/g' end)
  when 4 then null else (case when p_size <= 40 then p_size || '-' || (p_size + 5) || ' f/g' end) end as cell
from (select p_partkey, p_size from part) where true"""
)
def validated_cells(spark, sf_dir):
    """Cells of six kinds against the unit F/g; bare numbers and ranges also against 0 to 45."""
    kind, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    cell = (
        F.when(kind == 0, F.concat(n, F.lit(" F g-1").substr(F.lit(1), F.lit(2)), F.lit("/g"))).when(kind == 1, F.lit("2015")).when(kind == 2, F.concat(F.lit("annealing "), n))
        .when(kind == 3, n).when(kind == 4, F.concat(n, F.lit(" V"))).otherwise(F.concat(n, F.lit("-"), (F.col("p_size") + 5).cast("string")))
    )
    high = F.when(kind == 3, 40.0).when(kind == 5, 45.0)
    out = units.validate_cell(cell, F.array(F.lit("f/g")), F.lit(0.0), high)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("cell"))


VALIDATION = """v as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity as value, l_partkey % 4 as kind, l_suppkey % 5 as place from lineitem),
f as (
  select *, case kind when 0 then 1.0 when 1 then 0.7 when 2 then 0.2 else 0.0 end as unit,
    case when value < 0.5 or value > 400 then -1.0 when value between 5 and 40 then 1.1 else 0.7 end as rng,
    case place when 0 then 0.6 when 1 then 0.0 else 1.0 end as ctx from v),
c as (
  select *, case when unit = 0 or rng < 0 or ctx = 0 then 0.0
    else round((case when rng = 1.1 then least(1.0, 0.4 + 0.6 * unit + 0.1) else (0.4 + 0.6 * unit) * rng end) * ctx, 3) end as confidence from f)"""


@query(
    f"""with {VALIDATION}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(confidence as double) as confidence,
  case when unit = 0 then 'INVALID_UNIT' when confidence >= 0.9 then 'VALID' else 'REJECTED' end as status from c"""
)
def validation_confidence(spark, sf_dir):
    kind, place = F.col("l_partkey") % 4, F.col("l_suppkey") % 5
    unit = F.when(kind == 0, "F/g").when(kind == 1, "mF/g").when(kind == 3, "nm")
    dimension = F.when(kind.isin(0, 1), "capacitance_per_mass").when(kind == 3, "length")
    context = F.when(place == 0, "Fig. 3 shows it").when(place == 1, "Capacitance (F/g)").otherwise("as measured")
    low, high, value = F.lit(5.0), F.lit(40.0), F.col("l_quantity")
    u = validation.unit_score(unit, dimension, F.array(F.lit("F/g")), F.lit("capacitance_per_mass"))
    conf = validation.confidence(validation.type_factor(F.lit("float"), value, F.lit("12.5")), u, validation.range_factor(value, low, high), validation.context_factor(context))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", conf.alias("confidence"), u.alias("u"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "confidence", validation.status(F.col("confidence"), F.col("u")).alias("status"))


@query(
    """select p_partkey, translate(lower(trim(p_name || '-' || p_type)), ' -', '__') as attr_key, trim(regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', ' ', 'g')) as lookup,
  substr(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9]+', '_', 'g'), 1, 50) || '_' || substr(md5(p_name || '/' || p_type), 1, 6) || '.pdf' as filename,
  lower(regexp_replace(trim(p_name), '[^A-Za-z0-9_-]+', '_', 'g')) || '_' || substr(md5(p_type), 1, 4) as job,
  regexp_replace(lower(p_name), '[^a-z0-9_]+', '', 'g') as title_key from part"""
)
def name_keys(spark, sf_dir):
    both = F.concat("p_name", F.lit("-"), "p_type")
    name = F.concat("p_name", F.lit("/"), "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.attr_key(both).alias("attr_key"), text.lookup_key(both).alias("lookup"), text.safe_filename(name).alias("filename"),
        text.job_name(F.col("p_name"), F.md5("p_type")).alias("job"), text.title_key(F.col("p_name")).alias("title_key"),
    )


@query(
    """with w as (select p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' and x not in ('of', 'the', 'and')) as w from part),
g as (select p_partkey, list_concat(
  [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)],
  [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], w) as g from w)
select p_partkey, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|') as grams from g"""
)
def keyword_ngrams(spark, sf_dir):
    """Trigrams, bigrams and words of every name, each once; names are doubled, so that there are repeated ones."""
    name = F.concat("p_name", F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.ngrams(name, ["of", "the", "and"]), "|").alias("grams"))


@query(
    """select event_id, json_extract_string(props, '$.k')::bigint as k, '{"k":' || json_extract_string(props, '$.k') || '}' as found from events"""
)
def json_from_reply(spark, sf_dir):
    """The JSON object inside a fenced model reply."""
    compact = F.regexp_replace("props", r"\s", "")
    reply = F.concat(F.lit("Sure:\n```json\n"), compact, F.lit("\n``` [done]"))
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), reply.alias("reply"))
    return rows.select("event_id", "k", text.first_json(F.col("reply")).alias("found"))


@query(
    """select event_id, case when mx = mn then 0.0 when mx = r then 30.0 * (((g - b) / (mx - mn)) % 6 + case when (g - b) < 0 then 6 else 0 end) when mx = g then 30.0 * ((b - r) / (mx - mn) + 2) else 30.0 * ((r - g) / (mx - mn) + 4) end as hue,
  least(abs(event_id % 180 - 20), 180 - abs(event_id % 180 - 20)) as distance, round(4 * pi() * (event_id % 50 + 1) / pow(2.0 * ((event_id % 7 + 1) + (event_id % 5 + 1)), 2), 6) as circularity
from (select *, greatest(r, g, b) as mx, least(r, g, b) as mn from (select event_id, (event_id * 7 % 256)::double as r, (event_id * 13 % 256)::double as g, (event_id * 29 % 256)::double as b from events))"""
)
def colour_and_shape(spark, sf_dir):
    from lodestone.functions import geometry

    e = F.col("event_id")
    r, g, b = ((e * k % 256).cast("double") for k in (7, 13, 29))
    return table(spark, sf_dir, "events").select(
        "event_id", geometry.hue(r, g, b).alias("hue"), geometry.circular_distance(e % 180, F.lit(20)).alias("distance"),
        F.round(geometry.circularity(e % 50 + 1, e % 7 + 1, e % 5 + 1), 6).alias("circularity"),
    )
