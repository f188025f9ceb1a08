"""Queries of whole rules: every line, attribute and unit of a rule meets every kind of number.

Spark applies the operators; the SQL states each rule once more, by regular expressions and ordered lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import units, validation
from lodestone.operators import band, candidates, figures, matching, models, screening, tables
from lodestone.operators.candidates import (
    AXIS_LABELS, BARE_NUMBER, BINDER_WORDS, BOUND_PHRASES, BOUNDED, CONDITION_UNITS, CONTEXT_WORDS, ELEMENT_CONTENTS, FORMULA_SYMBOLS, METADATA_WORDS, NEAR_METADATA, NEAR_ZERO,
    NEVER_ZERO, NOT_NEGATIVE, NUMBER_AND_UNIT, PHYSICAL_RANGES, PLOT_FORMULA_SYMBOLS, PLOT_NEAR_METADATA, POSITIVE_ONLY, TRENDS, YEARLESS,
)
from lodestone.plans.registry import query, table

LINES = [
    "it was {} F/g", "see Fig. {} below it", "as shown [{}] there", "less than {} nm here", "Table {}", "Scheme {} shows it", "{} f/g overall", "published in {}", "J. X, Vol. {}, 3",
    "{} wt% PVDF in NMP was used", "Csp = I * t / {} V", "Csp = Es {}", "frequency ({} MHz)", "{}", "{} nm", "a value of {} nm", "{} m2/g was found above the rest", "x-axis {}",
    "in nm: {}", "doi:10.1/{} and so on", "held at {} V, http://x", "rates of {} A/g improved", "[1, 2, {}]", "it has {} in no unit at all", "no. 7 gave {} W/kg",
]
ATTRS = [a.title() if i % 3 == 0 else a for i, (a, *_) in enumerate(PHYSICAL_RANGES)] + ["voltage", "SPION concentration", "mean pore size (BJH)", "core volume", "colour"]
UNITS = [["F/g"], ["nm", " "], ["m2/g", "V"], [], ["A/g", "W/kg"]]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _in(name: str, values) -> str:
    return f"{name} in ({', '.join(map(_q, values))})"


def _contains(name: str, values) -> str:
    return f"list_bool_or(list_transform({_list(values)}, lambda w: contains({name}, w)))"


# numbers of all kinds, in the SQL of both engines
VALUE = "case l_linenumber + l_orderkey % 2 when 1 then '2010' when 2 then '-3' when 3 then '10-' || cast(l_quantity as bigint) when 4 then '0.005' when 5 then '1950.5' when 6 then '12.,' else '' || cast(l_quantity as bigint) end"
CASES = f"""n as (select l_suppkey % {len(LINES)} as t, l_partkey % {len(ATTRS)} as a, l_orderkey % {len(UNITS)} as u, {VALUE} as value, count(*) as n from lineitem group by all),
c as (select *, replace({_list(LINES)}[t + 1], '{{}}', value) as line, {_list(ATTRS)}[a + 1] as attr, lower({_list(ATTRS)}[a + 1]) as name, trim(value, '.,; ') as v,
  list_transform(list_filter([{', '.join(_list(u) + '::varchar[]' for u in UNITS)}][u + 1], lambda x: trim(x) <> ''), lambda x: regexp_escape(lower(trim(x)))) as units from n),
d as (select *, lower(line) as low, regexp_escape(v) as e, try_cast(regexp_extract(v, '^[-+]?[^-]*') as double) as num, try_cast(v as double) as whole, array_to_string(units, '|') as any_unit from c)"""


def _cases(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    keys = [(F.col(c) % n).alias(a) for c, n, a in (("l_suppkey", len(LINES), "t"), ("l_partkey", len(ATTRS), "a"), ("l_orderkey", len(UNITS), "u"))]
    rows = line.groupBy(*keys, F.expr(VALUE).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda values, i: F.get(F.array(*values), F.col(i).cast("int"))
    listed = [F.array(*map(F.lit, u)) if u else F.array().cast("array<string>") for u in UNITS]
    return rows.withColumns({"line": F.replace(pick(map(F.lit, LINES), "t"), F.lit("{}"), F.col("value")), "attr": pick(map(F.lit, ATTRS), "a"), "units": pick(listed, "u")})


REFERENCE = r"regexp_matches(line, '(?i)\b(fig(ure)?|table|ref|eq|step{scheme})\.?\s*\(?' || e || '\b')"
CITATION = r"regexp_matches(line, '\[[^\]]*?\b' || e || '\b[^\]]*?\]')"
AFTER = r"(len(units) = 0 or regexp_matches(low, e || '.{0,15}(' || any_unit || ')(\b|[^a-z]|$)'))"
AROUND = f"({AFTER} or regexp_matches(low, '(' || any_unit || ').{{0,5}}' || e))"
YEAR = f"coalesce({{number}} between 1900 and 2050, false) and ({_contains('low', METADATA_WORDS)} or {_in('name', YEARLESS)})"
NEAR = "list_bool_or(list_transform({marks}, lambda w: instr(low, w) > 0 and abs(instr(low, w) - instr(low, lower(v))) < 30))"
IMPOSSIBLE = f"coalesce(({_in('name', NOT_NEGATIVE)} and {{number}} < 0) or (name = 'voltage' and {{number}} > 10), false)"
FORMULA = "contains(line, '=') and (contains(line, '*') or contains(line, '/') or len(list_filter({symbols}, lambda w: contains(low, w))) >= 2)"
AXIS = f"(regexp_matches(low, {_q('|'.join(AXIS_LABELS))}) or regexp_matches(low, {_q(BARE_NUMBER)}) or (regexp_matches(low, {_q(NUMBER_AND_UNIT)}) and not {_contains('low', CONTEXT_WORDS)}))"
RANGES = "[" + ", ".join(f"{{'k': {_q(k)}, 'lo': {lo}::double, 'hi': {hi}::double, 'pos': {str(p).lower()}}}" for k, lo, hi, p in PHYSICAL_RANGES) + "]"
PLAUSIBLE = f"""(coalesce({{number}} >= case when {_in(f"list_filter({_list(POSITIVE_ONLY)}, lambda p: contains(name, p))[1]", NEVER_ZERO)} then {NEAR_ZERO} when list_filter({_list(POSITIVE_ONLY)}, lambda p: contains(name, p))[1] is not null then 0 end, true)
  and coalesce(list_transform(list_filter({RANGES}, lambda r: contains(name, r.k))[1:1], lambda r: {{number}} between r.lo and r.hi and ({{number}} > 0 or not r.pos))[1], true))"""
AT = "instr(low, lower(v))"
BOUND = f"{_in('name', BOUNDED)} and {_contains(f'substring(low, greatest(1, {AT} - 40), least({AT}, 41) + 39)', BOUND_PHRASES)}"


@query(
    f"""with {CASES} select t, a, u, value, n, case when {REFERENCE.replace('{scheme}', '|scheme')} then 'reference' when {YEAR.replace('{number}', 'num')} then 'year' when {CITATION} then 'citation'
  when {NEAR.format(marks=_list(NEAR_METADATA))} then 'metadata' when {_in('name', ELEMENT_CONTENTS)} and {_contains('low', BINDER_WORDS)} then 'binder' when {BOUND} then 'bound'
  when {AXIS} then 'axis label' when {IMPOSSIBLE.replace('{number}', 'num')} then 'impossible' when not {PLAUSIBLE.replace('{number}', 'num')} then 'range' when not {AFTER} then 'no unit' end as reason,
  regexp_matches(low, {_q(TRENDS)}) as trend from d"""
)
def false_positives(spark, sf_dir):
    """Numbers in lines of text, and the guard against trends."""
    line, value, attr, of = (F.col(c) for c in ("line", "value", "attr", "units"))
    return _cases(spark, sf_dir).select("t", "a", "u", "value", "n", candidates.text_false_positive(line, value, attr, of).alias("reason"), candidates.is_trend(line).alias("trend"))


@query(
    rf"""with {CASES.replace("trim(value, '.,; ') as v", "value as v")} select t, u, value, n, case when {REFERENCE.replace('{scheme}', '')} then 'reference' when {FORMULA.format(symbols=_list(FORMULA_SYMBOLS))} then 'formula'
  when regexp_matches(line, '\[\s*\d+[^\]]*' || e || '[^\]]*\]') then 'citation' when not {AROUND} then 'no unit' end as reason from (select t, u, value, line, v, units, low, e, any_unit, sum(n)::bigint as n from d group by all)"""
)
def table_false_positives(spark, sf_dir):
    rows = _cases(spark, sf_dir).groupBy("t", "u", "value", "line", "units").agg(F.sum("n").alias("n"))
    return rows.select("t", "u", "value", "n", candidates.table_false_positive(F.col("line"), F.col("value"), F.col("units")).alias("reason"))


@query(
    f"""with {CASES}, f as (select *, case when whole = floor(whole) then whole end as year from d)
select t, a, u, value, n, case when {REFERENCE.replace('{scheme}', '|scheme')} then 'reference' when {FORMULA.format(symbols=_list(PLOT_FORMULA_SYMBOLS))} then 'formula' when {YEAR.replace('{number}', 'year')} then 'year'
  when {CITATION} then 'citation' when {IMPOSSIBLE.replace('{number}', 'whole')} then 'impossible' when {NEAR.format(marks=_list(PLOT_NEAR_METADATA))} then 'metadata' when not {AROUND} then 'no unit' end as reason from f"""
)
def plot_false_positives(spark, sf_dir):
    line, value, attr, of = (F.col(c) for c in ("line", "value", "attr", "units"))
    return _cases(spark, sf_dir).select("t", "a", "u", "value", "n", candidates.plot_false_positive(line, value, attr, of).alias("reason"))


@query(
    f"""with c as (select l_partkey % {len(ATTRS)} as a, lower({_list(ATTRS)}[a + 1]) as name, case l_linenumber when 1 then -l_quantity when 2 then l_discount / 10 when 3 then l_extendedprice else l_quantity end as num from lineitem)
select a, num as value, {PLAUSIBLE.replace('{number}', 'num')} as plausible, count(*) as n from c group by all"""
)
def physical_ranges(spark, sf_dir):
    line = F.col("l_linenumber")
    value = F.when(line == 1, -F.col("l_quantity")).when(line == 2, F.col("l_discount") / 10).when(line == 3, F.col("l_extendedprice")).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % len(ATTRS)).alias("a"), value.alias("value"))
    rows = rows.withColumn("attr", F.get(F.array(*map(F.lit, ATTRS)), F.col("a").cast("int")))
    return candidates.within_physical_range(rows, "attr", "value").groupBy("a", "value", "plausible").agg(F.count(F.lit(1)).alias("n"))


UNIT_NAMES = ["A/g", "mA/g", "°C", "C", "V", "mV/s", "A", "mA", "K", "mV", "h", "min", "Hz", "nm", "F/g", "X", "mA/C", " k ", "%"]


@query(
    f"""with u as (select p_partkey, {_list(UNIT_NAMES)}[p_partkey % {len(UNIT_NAMES)} + 1] as unit, case when p_size % 2 = 0 then 'A/g' else 'K' end as own, p_size from part)
select p_partkey, {_in('lower(trim(unit))', CONDITION_UNITS)} and lower(trim(unit)) <> lower(own) as condition,
  coalesce({_in('lower(unit)', tables.AMBIGUOUS_UNITS)}, false) as by_unit, p_size < 30 as without_unit from u"""
)
def condition_units(spark, sf_dir):
    """Units of conditions in text, and those that make a table's cell ambiguous, with and without a weak header."""
    unit = F.get(F.array(*map(F.lit, UNIT_NAMES)), (F.col("p_partkey") % len(UNIT_NAMES)).cast("int"))
    own = F.array(F.when(F.col("p_size") % 2 == 0, "A/g").otherwise("K"))
    weak = tables.ambiguous(F.lit(None).cast("string"), F.col("p_size") / 40.0)
    return table(spark, sf_dir, "part").select("p_partkey", candidates.is_condition(unit, own).alias("condition"), tables.ambiguous(unit, F.lit(1.0)).alias("by_unit"), weak.alias("without_unit"))


# headers, cells and units
SCHEMA = [("metal", ["steel", "polished brass", "burnished copper"], ["g"]), ("colour", ["red", "deep red shade of it"], []), ("finish", ["gold metallic finish", "metallic"], ["%", "nm"]), ("shape", ["large anvil", "anvil small case"], ["F/g"])]
BRACKETS = [" (F/g)", " [Wh kg-1]", " (nm)", " (mean)", "", " (°C)", " [at %]", " (a) (m2 g-1)", " (Hz, mean)"]
HEADER = f"p_name || ' ' || p_type || {{brackets}}[p_partkey % {len(BRACKETS)} + 1]"
HEADER_UNIT = r"""coalesce(nullif(regexp_extract({h}, '(?i)[(\[]([^)\]]+(?:/|g-|kg-|cm-|m-)[^)\]]*)[)\]]', 1), ''), nullif(regexp_extract({h}, '[(\[]([^)\]]*[²³°%][^)\]]*)[)\]]', 1), ''),
  nullif(regexp_extract({h}, '(?i)[(\[]((?:[^)\]]*[^A-Za-z)\]])?(?:nm|[μµ]m|um|mm|cm|m|s|Hz)(?:[^A-Za-z)\]][^)\]]*)?)[)\]]', 1), ''))"""


def _headers(spark, sf_dir):
    tail = F.get(F.array(*map(F.lit, BRACKETS)), (F.col("p_partkey") % len(BRACKETS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat("p_name", F.lit(" "), "p_type", tail).alias("header"))


SLASHED = r"regexp_replace(regexp_replace(regexp_replace({u}, '^(\S+?)[ ·]([a-zA-Z]+)-1$', '\1/\2'), 'm2($|/)', 'm²\1'), 'm3($|/)', 'm³\1')"


@query(f"with h as (select p_partkey, {HEADER.format(brackets=_list(BRACKETS))} as h from part), u as (select p_partkey, trim({HEADER_UNIT.format(h='h')}) as u from h) select p_partkey, {SLASHED.format(u='u')} as unit from u")
def header_units(spark, sf_dir):
    return _headers(spark, sf_dir).select("p_partkey", units.header_unit(F.col("header")).alias("unit"))


ALIAS_ROWS = ", ".join(f"({_q(a)}, {i}, {_q(x.lower())}, {j}, {_q(u[0]) if u else 'null'})" for i, (a, al, u) in enumerate(SCHEMA) for j, x in enumerate([a, *al]))


@query(
    f"""with al(attribute, i, alias, j, own) as (values {ALIAS_ROWS}), h as (select p_partkey, {HEADER.format(brackets=_list(BRACKETS))} as h from part),
w as (select h.*, al.*, lower(h) as low, string_split_regex(lower(trim(h)), '\\s+') as hw, string_split(alias, ' ') as aw from h, al),
s as (select *, len(list_filter(aw, lambda x: length(x) > 3 and list_contains(hw, x))) as m from w),
b as (select p_partkey, h, attribute, own, greatest(case when contains(low, alias) then length(alias) / length(h) else 0 end, case when m >= greatest(1, len(aw) // 2) then m / len(aw) else 0 end) as score, i, j from s),
r as (select *, row_number() over (partition by p_partkey order by score desc, i, j) as k, {SLASHED.format(u=f"trim({HEADER_UNIT.format(h='h')})")} as found from b)
select p_partkey, case when score > 0 then attribute end as attribute, coalesce(found, case when score > 0 then own end) as unit,
  round(least(1.0, score + case when coalesce(found, case when score > 0 then own end) is not null then 0.2 else 0 end), 9) as confidence from r where k = 1"""
)
def header_attribute(spark, sf_dir):
    schema = spark.createDataFrame([(a, al, u, i) for i, (a, al, u) in enumerate(SCHEMA)], "attribute string, aliases array<string>, units array<string>, ordinal int")
    return matching.header_attribute(_headers(spark, sf_dir), "header", schema).select("p_partkey", "attribute", "unit", F.round("confidence", 9).alias("confidence"))


KNOWN = ["F/g", "A/g", "Wh/kg", "nm", "V", "mV/s", "%", "g", "m"]
CELL = "case p_partkey % 6 when 0 then p_size || ' F/g at ' || p_partkey % 9 || 'A/g' when 1 then p_size || ' (Wh kg-1) and 3 V' when 2 then '' || p_size when 3 then p_size || ' - ' || (p_size + 4) when 4 then p_size || ' gram' else p_brand || ' 1.5e2 MV/S' end"
PAIRS = rf"list_concat(list_zip(regexp_extract_all(c, '(\d+\.?\d*)\s*[(\[]([^)\]]+)[)\]]', 1), list_transform(regexp_extract_all(c, '(\d+\.?\d*)\s*[(\[]([^)\]]+)[)\]]', 2), lambda x: trim(x))), list_zip(regexp_extract_all(c, '(?i)(\d+\.?\d*(?:e[-+]?\d+)?)\s*({'|'.join(sorted(KNOWN, key=lambda u: (-len(u), u)))})(?:[^A-Za-z0-9]|$)', 1), regexp_extract_all(c, '(?i)(\d+\.?\d*(?:e[-+]?\d+)?)\s*({'|'.join(sorted(KNOWN, key=lambda u: (-len(u), u)))})(?:[^A-Za-z0-9]|$)', 2)))"


@query(f"with c as (select p_partkey, {CELL} as c from part), p as (select p_partkey, unnest({PAIRS}) as p from c) select p_partkey, p[1] as value, p[2] as unit, count(*) as n from p group by all")
def value_unit_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.explode(units.known_value_units(F.expr(CELL), KNOWN)).alias("p"))
    return pairs.groupBy("p_partkey", "p.value", "p.unit").agg(F.count(F.lit(1)).alias("n"))


@query(
    rf"""with c as (select p_partkey, p_size, {CELL} as c from part), q as (select *, {PAIRS} as q from c)
select p_partkey, coalesce(q[1][2], 'F/g') as unit, coalesce(try_cast(q[1][1] as double), case p_partkey % 6 when 2 then p_size::double when 3 then p_size + 2.0 when 4 then p_size::double end) as value from q"""
)
def cell_values(spark, sf_dir):
    """The cell's own unit, else the header's."""
    cell = units.cell_value(F.expr(CELL), F.lit("F/g"), KNOWN)
    return table(spark, sf_dir, "part").select("p_partkey", cell["unit"].alias("unit"), cell["value"].alias("value"))


# keywords and numbers
@query(
    r"""with w as (select item_id, unnest(string_split_regex(trim(text), '\s+')) as raw, generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 as i from benchmark),
k as (select item_id, i from w where trim(lower(raw), '.,()[]') in ('the', 'of', 'and')),
v as (select item_id, i as place, regexp_extract(raw, '[-+]?\d+(?:\.\d+)?(?:\s*[-,–—]\s*\d+(?:\.\d+)?|(?:\s*,\s*\d+(?:\.\d+)?)+)?') as value from (select item_id, i, raw || i as raw from w) where regexp_matches(raw, '\d'))
select item_id, k.i as word, place, value from k join v using (item_id) where place between i - 8 and i + 8 and place <> i"""
)
def keyword_window_values(spark, sf_dir):
    """Numbers within eight words of a keyword; every word of ``benchmark`` gets its number behind it, so that there are some."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "raw"))
    marked = words.withColumn("numbered", F.concat("raw", F.col("i").cast("string")))
    found = candidates.window_values(marked, "item_id", "i", "raw", "numbered", ["the", "of", "and"])
    return found.select("item_id", F.col("word").cast("long").alias("word"), F.col("at").cast("long").alias("place"), "value")


FORWARD, BACKWARD = r"(?:pore size|size).{0,50}?\b([-+]?\d+(?:\.\d+)?)", r"\b([-+]?\d+(?:\.\d+)?).{0,50}?(?:pore size|size)"
SENTENCE = "'The ' || p_name || ' of pore size near ' || p_size || ' nm, with ' || p_partkey || ' and ' || p_brand || ' of the size'"


@query(f"with s as (select p_partkey, lower({SENTENCE}) as s from part) select p_partkey, value, count(*) as n from (select p_partkey, unnest(list_concat(regexp_extract_all(s, '{FORWARD}', 1), regexp_extract_all(s, '{BACKWARD}', 1))) as value from s) group by all")
def keyword_numbers(spark, sf_dir):
    """Numbers up to fifty characters after or before a keyword."""
    found = candidates.keyword_numbers(F.expr(SENTENCE), ["pore size", "size"], 50)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("value")).groupBy("p_partkey", "value").agg(F.count(F.lit(1)).alias("n"))


# screening from text to verdict
TERMS = [("the", "primary", "a", 0), ("under the", "primary", "b", 1), ("und", "alias", "b", 2), ("de la", "alias", "c", 3), ("license", "alias", "a", 4), ("of", "secondary", "c", 5)]


@query(
    rf"""with t(term, strength, attribute, o) as (values {', '.join(map(str, TERMS))}), d as (select doc_id, text, lower(text) as low from documents),
n as (select doc_id, strength, count(*) as n from (select doc_id, strength, unnest(regexp_extract_all(' ' || regexp_replace(low, '[^a-z0-9]+', '  ', 'g') || ' ', ' ' || replace(term, ' ', '  ') || ' ')) from d, t where not contains(term, ' ')) group by all),
p as (select doc_id, sum(n) filter (strength = 'primary') as p1, sum(n) filter (strength = 'alias') as a1, sum(n) filter (strength = 'secondary') as s1 from n group by 1)
select doc_id, coalesce(length(trim(text)) >= 50, false) as enough,
  case when coalesce(length(trim(text)) >= 50, false) then round(case when coalesce(p1, 0) + coalesce(a1, 0) > 0 then least(0.4, 0.12 * coalesce(p1, 0) + 0.08 * coalesce(a1, 0) + 0.04 * coalesce(s1, 0)) else 0 end, 3) else 0 end::double as score,
  coalesce(length(trim(text)) >= 50, false) and coalesce(p1, 0) + coalesce(a1, 0) > 0 and least(0.4, 0.12 * coalesce(p1, 0) + 0.08 * coalesce(a1, 0) + 0.04 * coalesce(s1, 0)) >= 0.4 as include from d left join p using (doc_id)"""
)
def screened_documents(spark, sf_dir):
    """From texts to verdicts: hits of keywords, score and both gates."""
    docs = table(spark, sf_dir, "documents")
    terms = spark.createDataFrame([t[:3] for t in TERMS if " " not in t[0]], "term string, strength string, attribute string")
    counts = screening.strength_counts(screening.term_hits(docs, "doc_id", "text", terms), "doc_id")
    joined = docs.join(counts, "doc_id", "left").na.fill(0, ["primary", "alias", "secondary"])
    score = F.when((F.col("primary") + F.col("alias")) > 0, screening.keyword_score(F.col("primary"), F.col("alias"), F.col("secondary"))).otherwise(0.0)
    return screening.gated(joined.withColumn("score", F.round(score, 3)), "text", "score").select("doc_id", "enough", "score", "include")


@query(
    r"""with w as (select doc_id, string_split_regex(lower(text), '[^a-z0-9]+') as w from documents), x as (select doc_id, generate_subscripts(w, 1) - 1 as word, unnest(w) as term from w),
k as (select doc_id, word, case term when 'the' then 'a' else 'b' end as attribute from x where term in ('the', 'die')),
al(term, attribute, o) as (values ('and', 'a', 0), ('was', 'a', 1), ('the', 'a', 2), ('und', 'b', 3), ('license', 'c', 4), ('licensed', 'a', 5)),
h as (select x.doc_id, word, x.term, al.attribute, o from x join al using (term)),
g as (select h.* from h where case when exists (select 1 from k where k.doc_id = h.doc_id) then exists (select 1 from k where k.doc_id = h.doc_id and k.attribute = h.attribute) else length(term) >= 5 end
  and not exists (select 1 from k where k.doc_id = h.doc_id and k.word = h.word))
select doc_id, word, term, attribute from g qualify row_number() over (partition by doc_id, word order by o) = 1"""
)
def triggered_aliases(spark, sf_dir):
    """Aliases of the attributes that keywords bring up, at places without a keyword; else all of five letters or more."""
    docs = table(spark, sf_dir, "documents")
    keys = spark.createDataFrame([("the", "primary", "a"), ("die", "primary", "b")], "term string, strength string, attribute string")
    aliases = spark.createDataFrame([("and", "alias", "a", 0), ("was", "alias", "a", 1), ("the", "alias", "a", 2), ("und", "alias", "b", 3), ("license", "alias", "c", 4), ("licensed", "alias", "a", 5)], "term string, strength string, attribute string, ordinal int")
    hits = screening.triggered_aliases(docs, "doc_id", "text", aliases, screening.term_hits(docs, "doc_id", "text", keys))
    return hits.select("doc_id", F.col("word").cast("long").alias("word"), "term", "attribute")


@query(
    """with r as (select l_orderkey, l_shipdate, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem),
d as (select l_orderkey, l_shipdate, min(k) as k from r group by all)
select l_orderkey, array_to_string(list(cast(l_shipdate as varchar) order by k)[1:3], ';') as first_three, count(*) as different, count(*) <= 5 as simple from d group by 1"""
)
def ordered_distinct(spark, sf_dir):
    """Proofs in order without repeats, the first of them, and whether a plot has few enough series."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    found = screening.ordered_distinct(rows, "l_orderkey", "l_shipdate", "at")
    return found.select("l_orderkey", F.array_join(F.transform(screening.leading("values", 3), lambda d: d.cast("string")), ";").alias("first_three"), F.size("values").cast("long").alias("different"), figures.simple_plot(F.col("values"), 5).alias("simple"))


@query("select word from (select unnest(string_split(lower(p_name), ' ')) as word from part union select lower(p_type) from part union select lower(p_brand) from part) where word <> '' group by 1")
def vocabulary(spark, sf_dir):
    """The union of several vocabularies."""
    part = table(spark, sf_dir, "part")
    return models.vocabulary(part.select(F.explode(F.split("p_name", " ")).alias("word")), part.select(F.col("p_type").alias("word")), part.select(F.col("p_brand").alias("word")))


CAPTIONS = ["capacitance against voltage", "SEM of carbon", "the proposed setup", "assembly", "scale bar and diagram", "system item"]


@query(
    rf"""with c as (select p_partkey, p_size, lower({_list(CAPTIONS)}[p_partkey % {len(CAPTIONS)} + 1]) as c from part),
s as (select *, case when regexp_matches(c, '\b(tem|sem|afm|scale bar|magnification|nanometer|μm|nm)\b') then 'microscopy' when regexp_matches(c, '\b(setup|scheme|illustration|proposed|apparatus|diagram)\b') then 'schematic' else 'graph' end as signal from c),
p as (select *, greatest(0, case when p_size > 10 then 40 else 0 end + case when p_size > 25 then 30 else 0 end + case signal when 'graph' then 30 when 'microscopy' then -60 else -40 end) as score from s)
select p_partkey, score, signal, score < 40 as skipped, (p_size * 10 >= 150 and p_partkey % 400 >= 150) as large, (p_retailprice > -1000 and p_retailprice < 100000) as plausible from p join (select p_partkey, p_retailprice from part) using (p_partkey)"""
)
def figure_scores(spark, sf_dir):
    """One signal of the caption's words beside axes and ticks; figures below 40 are skipped."""
    caption = F.get(F.array(*map(F.lit, CAPTIONS)), (F.col("p_partkey") % len(CAPTIONS)).cast("int"))
    s = F.col("p_size")
    scored = table(spark, sf_dir, "part").withColumn("signal", figures.caption_signal(caption)).withColumn("score", figures.figure_score(s > 10, s > 25, F.col("signal")))
    return scored.select(
        "p_partkey", "score", "signal", (F.col("score") < figures.LEAST_SCORE).alias("skipped"), figures.large_enough(s * 10, F.col("p_partkey") % 400).alias("large"),
        figures.plausible_plot_value(F.col("p_retailprice")).alias("plausible"),
    )


# scores of units and attributes, ticks and swatches
DIMENSIONED = [("F/g", "capacitance_per_mass"), ("f/G ", "capacitance_per_mass"), ("mF/g", "capacitance_per_mass"), ("A/g", "current_per_mass"), ("nm", "length"), ("", None), (None, None)]
_DIMENSIONED = "[" + ", ".join(f"{{'u': {_q(u) if u is not None else 'null'}, 'd': {_q(d) if d else 'null'}}}" for u, d in DIMENSIONED) + "]"


@query(
    f"""with c as (select p_partkey, {_DIMENSIONED}[p_partkey % {len(DIMENSIONED)} + 1] as x, p_size % 3 as k from part), u as (select p_partkey, x.u as u, x.d as d, k from c)
select p_partkey, case when coalesce(trim(u), '') = '' then case when k = 2 then 0.5 else 0.2 end when k = 2 then 0.5 when lower(trim(u)) = 'f/g' then 1.0 when d = 'capacitance_per_mass' and k = 0 then 0.7
  when d in ('capacitance_per_mass', 'current_per_mass') then 0.6 else 0.0 end::double as score from u"""
)
def unit_scores(spark, sf_dir):
    """Exact, of the attribute's dimension, compatible with an expected unit, missing, foreign; and with no unit expected."""
    at, k = (F.col("p_partkey") % len(DIMENSIONED)).cast("int"), F.col("p_size") % 3
    pick = lambda i: F.get(F.array(*[F.lit(x[i]).cast("string") for x in DIMENSIONED]), at)
    none = F.array().cast("array<string>")
    expected = F.when(k == 2, none).otherwise(F.array(F.lit("F/g")))
    compatible = F.array(F.lit("capacitance_per_mass"), F.lit("current_per_mass"))
    score = validation.unit_score(pick(0), pick(1), expected, F.when(k == 0, "capacitance_per_mass").otherwise("length_of_nothing"), compatible)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("double").alias("score"))


@query(
    f"""with c as (select p_partkey, {_DIMENSIONED}[p_partkey % {len(DIMENSIONED)} + 1].u as u, lower(p_name || ' ' || p_type) as ctx, p_size::double + 0.1 as v from part),
s as (select *, case when coalesce(trim(u), '') = '' then case when p_partkey % 2 = 0 then 0.5 else 0 end when lower(trim(u)) = 'f/g' then 1.0 when u = 'mF/g' then 0.8 else 0 end as a,
  case when contains(ctx, 'red') or contains(ctx, 'polished brass') then 1.0 when contains(ctx, 'polished') or contains(ctx, 'brass') then 0.7 else 0 end as b,
  case when v between 10 and 30 then 1.0 - abs(v - 20.0) / 20.0 * 0.3 when v < 10 then greatest(0, 1.0 - (10 - v) / 10) else greatest(0, 1.0 - (v - 30) / 30) end as r from c)
select p_partkey, case when a = 0 then 0.0 else round(0.6 * a + 0.3 * b + 0.1 * r, 3) end::double as score from s"""
)
def attribute_matches(spark, sf_dir):
    unit = F.get(F.array(*[F.lit(x[0]).cast("string") for x in DIMENSIONED]), (F.col("p_partkey") % len(DIMENSIONED)).cast("int"))
    score = validation.attribute_match(
        unit, F.array(F.lit("F/g")), F.coalesce(unit == "mF/g", F.lit(False)), F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), "p_type"),
        F.array(F.lit("red"), F.lit("polished brass")), F.col("p_size") + F.lit(0.1), F.lit(10.0), F.lit(30.0),
    )
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query(
    r"""with l as (select user_id as image, event_id as seq, event_type || ' ' || (event_id % 90) || '.5' as text, event_id % 611 as cx, event_id % 397 as cy from events),
a as (select *, case when cy > 300 then 'x' when cx < 100 then 'y' end as axis, regexp_extract(text, '[-+]?\d+(\.\d+)?')::double as value from l),
t as (select axis, o * 20.0 as tick, o as ordinal from (values ('x'), ('y')) v(axis), range(0, 40) r(o)),
n as (select image, axis, seq, value, arg_min(tick, ordinal) as tick from a join t using (axis) where abs(case axis when 'x' then cx else cy end - tick) < 15 group by all)
select image, axis, tick::double as tick, arg_max(value, seq) as value from n group by all"""
)
def tick_values(spark, sf_dir):
    """Labels at the first near tick of the axis on whose side they are."""
    i = F.col("event_id")
    labels = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("image"), i.alias("seq"), F.concat("event_type", F.lit(" "), (i % 90).cast("string"), F.lit(".5")).alias("text"),
        (i % 611).alias("cx"), (i % 397).alias("cy"), F.lit(100).alias("origin_x"), F.lit(300).alias("origin_y"),
    )
    grid = labels.select("image").distinct().withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return band.tick_values(labels, grid.withColumn("tick", F.col("ordinal") * 20.0))


@query("select user_id as image, event_type as box, round(avg(event_id % 180), 6) as mean from events where event_id % 50 >= 10 and event_id % 50 < 30 and event_id % 70 < 40 and event_type <> 'view' group by all")
def swatch_hues(spark, sf_dir):
    """The mean hue in each swatch of an image."""
    i = F.col("event_id")
    seen = table(spark, sf_dir, "events")
    pixels = seen.select(F.concat_ws("|", "user_id", "event_type").alias("image"), "user_id", "event_type", (i % 50).alias("px"), (i % 70).alias("py"), (i % 180).alias("hue"))
    boxes = pixels.filter("event_type <> 'view'").select("image", "user_id", F.col("event_type").alias("box")).distinct()
    boxes = boxes.select("image", F.struct("user_id", "box").alias("box"), F.lit(10).alias("left"), F.lit(30).alias("right"), F.lit(0).alias("top"), F.lit(40).alias("bottom"))
    found = band.mean_inside(pixels.select("image", "px", "py", "hue"), boxes, "hue")
    return found.select(F.col("box.user_id").alias("image"), F.col("box.box").alias("box"), F.round("mean", 6).alias("mean"))


@query(
    """with h as (select p_partkey, p_name || ' (' || p_type || ')' as header, p_partkey % 4 as k from part)
select p_partkey, header, case k when 0 then 'pore size' when 2 then 'pore volume' else 'by rule' end as attribute,
  case k when 0 then 'nm' when 1 then 'g' when 3 then 'g' end as unit, case k when 0 then 0.95 when 2 then 0.8 else 0.5 end::double as confidence from h"""
)
def reviewed_headers(spark, sf_dir):
    """A model's answers over the match by rules: one attribute, none, the surest of two, and no answer at all."""
    rows = table(spark, sf_dir, "part").withColumns({"header": F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), "k": F.col("p_partkey") % 4})

    def said(attribute: str, unit: str | None, confidence: float):
        return F.struct(F.col("header").alias("original_header"), F.lit(attribute).alias("mapped_attribute"), F.lit(unit).cast("string").alias("extracted_unit"), F.lit(confidence).alias("confidence"))

    answer = F.when(F.col("k") == 0, F.to_json(F.struct(F.array(said("pore size", "nm", 0.95)).alias("headers"))))
    answer = answer.when(F.col("k") == 1, F.to_json(F.array(said(models.UNKNOWN_HEADER, None, 1.0)))).when(F.col("k") == 2, F.to_json(F.array(said("pore size", "nm", 0.3), said("pore volume", None, 0.8))))
    headers = rows.select("p_partkey", "header", F.lit("by rule").alias("attribute"), F.lit("g").alias("unit"), F.lit(0.5).alias("confidence"))
    return models.reviewed_headers(headers, rows.select("p_partkey", answer.alias("answer")).filter("answer is not null"), "p_partkey")
