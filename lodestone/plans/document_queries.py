"""Queries over documents: lines, pages, routing, relevance and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import pages, screening
from lodestone.plans.registry import query, table

WORDS = r"[^ \t\r\n]+"
NUMBERS = r"[0-9]+(?:\.[0-9]+)?"


@query(
    r"""select doc_id, trim(regexp_replace(translate(text, '−–—·µμ', '---.uu'), '[ \t\r\n]+', ' ', 'g')) as cleaned from documents"""
)
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_line(F.col("text")).alias("cleaned"))


@query(
    r"""select doc_id, length(regexp_replace(t, '(?is)\n\s*(?:references|bibliography|acknowledgements?|appendix|supporting information)\s*\n.*$', '')) as kept
from (select doc_id, case when doc_id % 3 = 0 then text || E'\n References \n[1] ' || lang else text end as t from documents)"""
)
def back_matter_strip(spark, sf_dir):
    full = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n References \n[1] "), "lang")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.strip_back_matter(full)).cast("long").alias("kept"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)
select doc_id, cast(line as integer) as line, concat_ws(' ', lag(content) over w, content, lead(content) over w) as context from l window w as (partition by doc_id order by line)"""
)
def line_context(spark, sf_dir):
    return pages.line_context(pages.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "line", "context")


@query(
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents)
select doc_id, cast(line as integer) as line from l where not regexp_matches(content, '(?i)\b(?:increased|decreased|higher|lower|better|worse|improved|reduced|dropped|rose|trend)\b')
and not regexp_matches(content, '(?i)\b(?:calculated|simulated|theoretical|predicted|expected|estimated|modeled)\b')
and not regexp_matches(content, '(?i)\b(?:prepared|synthesized|washed|heated|cooled|stirred|mixed|added|dropwise|annealed)\b') and regexp_matches(content, '[0-9]+(?:\.[0-9]+)?\s*[a-zA-Z%/µ·²]')"""
)
def measured_lines(spark, sf_dir):
    return pages.measured_lines(pages.lines(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "line")


@query(
    r"""with l as (select doc_id, case when i % 4 = 3 and doc_id % 2 = 0 then ' References ' else 'row ' || i end as content, i as line from documents, range(0, 10) t(i)),
s as (select *, max(case when regexp_matches(content, '(?i)^\s*(?:references|bibliography)\s*$') and line > 10 * 0.5 then 1 else 0 end) over (partition by doc_id order by line) as seen from l)
select doc_id, count(*) as kept from s where seen = 0 or line <= 7 group by doc_id"""
)
def references_cut(spark, sf_dir):
    i = F.col("line")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("line"))
    rows = rows.withColumn("content", F.when((i % 4 == 3) & (F.col("doc_id") % 2 == 0), " References ").otherwise(F.concat(F.lit("row "), i)))
    return pages.before_references(rows, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


PAGES = r"""p as (select doc_id, page, substr(text, (page - 1) * 1000 + 1, 1000) as content from (
  select doc_id, text, unnest(range(1, greatest(1, cast(ceil(length(text) / 1000.0) as bigint)) + 1)) as page from documents)),
d as (select *, len(regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?')) as numbers, len(regexp_extract_all(content, '[^ \t\r\n]+')) as words from p)"""


@query(
    f"""with {PAGES}, s as (select doc_id, page, case when words = 0 then 0.0 else numbers / words end as density, numbers from d)
select doc_id, count(*) as n_pages, count(*) filter (page <= 3 or (density > 0.05 and numbers >= 5)) as sampled, max(density) as densest from s group by doc_id"""
)
def page_sampling(spark, sf_dir):
    p = pages.pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    density = p.select("doc_id", "page", tx.numeric_density(F.col("content")).alias("density")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("density").alias("densest"))
    return density.join(pages.sampled_text(p, "doc_id").select("doc_id", F.col("n_pages").alias("sampled")), "doc_id").select("doc_id", "n_pages", "sampled", "densest")


@query(
    f"""with {PAGES}, last as (select doc_id, max(page) as n from p group by 1)
select p.doc_id, page, (page > n * 0.8 and regexp_matches(right(lower(content), 1000), 'public|license')) or contains(lower(content), 'thanks') as ignored_like,
  (page > n * 0.8 and regexp_matches(right(lower(content), 1000), 'references|bibliography')) or contains(lower(content), 'acknowledgement') as ignored from p join last using (doc_id)"""
)
def ignored_sections(spark, sf_dir):
    from pyspark.sql import Window

    p = pages.pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    low, last = F.lower("content"), F.max("page").over(Window.partitionBy("doc_id"))
    like = ((F.col("page") > last * 0.8) & F.right(low, F.lit(1000)).rlike("public|license")) | low.contains("thanks")
    return p.select("doc_id", F.col("page").cast("long").alias("page"), like.alias("ignored_like"), pages.ignored_section(p, "doc_id").alias("ignored"))


@query(
    f"""with {PAGES}, s as (select doc_id, page, least(1.0, 0.1 * numbers) as table_score, least(1.0, words / 300.0) as plot_score, case when numbers > 0 then 0.25 else 0.0 end as text_score from d)
select doc_id, coalesce(array_to_string(list(page order by page) filter (table_score >= 0.4), ','), '') as tables_pages,
  coalesce(array_to_string(list(page order by page) filter (plot_score >= 0.4), ','), '') as plots_pages, coalesce(array_to_string(list(page order by page) filter (text_score >= 0.25), ','), '') as text_pages
from s group by doc_id"""
)
def page_density_route(spark, sf_dir):
    p = pages.pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    n, w = tx.n_numbers(F.col("content")), tx.n_words(F.col("content"))
    scored = p.select("doc_id", "page", F.least(F.lit(1.0), 0.1 * n).alias("table_score"), F.least(F.lit(1.0), w / 300.0).alias("plot_score"), F.when(n > 0, 0.25).otherwise(0.0).alias("text_score"))
    routed = pages.route(scored, "doc_id")
    return routed.select("doc_id", *[F.array_join(c, ",").alias(c) for c in pages.ROUTES])


@query(
    r"""with d as (select doc_id, lower(text) as low from documents),
m as (select doc_id, len(regexp_extract_all(low, '[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?\s*(?:der|the|de)([^a-z0-9]|$)')) as n from d)
select doc_id, case when n * 0.2 >= 8 then 1.0 when n * 0.2 >= 4 then 0.75 when n * 0.2 >= 1 then 0.4 else 0.0 end::double as score from m"""
)
def text_density_score(spark, sf_dir):
    """Measurements with the "units" der, the and de; the keyword occurs nowhere."""
    return table(spark, sf_dir, "documents").select("doc_id", pages.text_score(F.col("text"), "der|the|de", "no such keyword").alias("score"))


@query(
    r"""with d as (select doc_id, replace(lower(text), ' the ', ' 7 nm ') as low from documents),
m as (select doc_id, low, string_split_regex(low, '[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?\s*(?:nm)(?:[^a-z0-9]|$)') as gaps, regexp_extract_all(low, '[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?\s*(?:nm)(?:[^a-z0-9]|$)') as full_,
  regexp_extract_all(low, '([0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?\s*(?:nm))(?:[^a-z0-9]|$)', 1) as core from d),
e as (select doc_id, low, i, length(gaps[i]) as gap, length(full_[i]) as whole, length(core[i]) as n from (select *, unnest(range(1, len(full_) + 1)) as i from m)),
s as (select doc_id, low, n, sum(gap + whole) over (partition by doc_id order by i) - whole as start from e),
w as (select doc_id, case when regexp_matches(substr(low, cast(greatest(start - 80, 0) + 1 as bigint), cast(start + n + 80 - greatest(start - 80, 0) as bigint)), 'tion|ement') then 10 else 2 end as tenths from s),
p as (select doc_id, sum(tenths) as points from w group by 1)
select doc_id, case when points >= 80 then 1.0 when points >= 40 then 0.75 when points >= 10 then 0.4 else 0.0 end::double as score from documents left join p using (doc_id)"""
)
def text_density_near_keywords(spark, sf_dir):
    """Each " the " stands for a measurement in nm; the keywords occur near some of them."""
    low = F.replace(F.lower("text"), F.lit(" the "), F.lit(" 7 nm "))
    return table(spark, sf_dir, "documents").select("doc_id", pages.text_score(low, "nm", "tion|ement").alias("score"))


@query(
    """select p_partkey, case when p_size % 4 > 0 then least(1.0, 0.3 + 0.1 * (p_size % 4) + 0.5 * coalesce((p_size % 7) / nullif(p_size % 11, 0), 0) + least(0.2, greatest(0.0, (p_size % 9 - 2) * 0.05))) else 0.0 end::double as table_score,
  greatest(coalesce(case when p_size % 3 > 0 then 0.6 * (p_size % 3) / 3 + 0.4 * (p_size % 5) / 5 else 0.4 * (p_size % 5) / 5 end, 0), case when p_size % 4 >= 2 and p_size > 20 then 0.4 else 0.0 end)::double as plot_score from part"""
)
def page_scores(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", pages.table_score(s % 4, s % 7, s % 11, s % 9).alias("table_score"),
        pages.plot_score(F.when(s % 3 > 0, (s % 3) / 3), (s % 5) / 5, s % 4, s).alias("plot_score"),
    )


@query(
    r"""with d as (select doc_id, lower(text) as low from documents),
h as (select *, regexp_matches(low, '\bthe\b') as a, regexp_matches(low, '\bthat(?:\W+\w+){0,4}?\W+and\b') as b, regexp_matches(low, '\bsicherung\w*\b') as c0, regexp_matches(low, '\bund\b') as s1,
  regexp_matches(low, 'tion|ment') as q, regexp_matches(low, '\b[0-9]+(?:\.[0-9]+)?\s*(?:of|der)\b') as n from d)
select doc_id, case when a or b then least(1.0, 0.25 * cast(q as int) + 0.25 * least(1.0, (cast(a as int) + 2 * cast(b as int) + cast(s1 as int)) / 3.0) + 0.25 * least(1.0, cast(b as int) / 2.0) + 0.15 * cast(n as int) + 0.1) else 0.0 end::double as score,
from h"""
)
def relevance_score(spark, sf_dir):
    score = screening.relevance(F.col("text"), ["the", "that and"], ["und"], "tion ment", ["of", "der"])
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query(
    """with d as (select doc_id, lower(text) as low from documents), f as (select doc_id, (len(regexp_extract_all(low, 'license|public')) > 0) as review, doc_id % 2 = 0 as data,
  doc_id % 5 as p, doc_id % 3 as a, doc_id % 4 as s, doc_id % 6 as attrs, doc_id % 30 as m, doc_id % 4 as sh, doc_id % 7 as strong, doc_id % 11 as weak from d)
select doc_id, case when p + a > 0 then round(least(1.0, least(0.40, 0.12 * p + 0.08 * a + 0.04 * s) + least(0.20, 0.07 * attrs) + least(0.10, 0.03 * ln(1 + m)) + least(0.30, 0.10 * sh)
  + least(0.10, 0.10 * least(1.0, least(1.0, strong * 0.4) + 0.3 * least(0.5, weak * 0.1)))) * case when review and not data then 0.7 when review then 0.85 else 1.0 end, 3) else 0.0 end::double as score from f"""
)
def screening_score(spark, sf_dir):
    i = F.col("doc_id")
    review = F.lower("text").rlike("license|public")
    kind = F.when(review & (i % 2 != 0), "review").when(review, "review_with_data").otherwise("research_article")
    score = screening.final_score(i % 5, i % 3, i % 4, i % 6, i % 30, i % 4, i % 7, i % 11, kind)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query(
    """with d as (select item_id, lower(text) || case item_id % 3 when 0 then ' a literature review of results' when 1 then ' an overview' else ' experimental' end as low from benchmark),
f as (select item_id, regexp_matches(low, 'review|survey|meta-analysis|overview|perspective') as r, regexp_matches(low, 'experimental|methodology|characterization|synthesis|electrochemical|results|fabrication') as e from d)
select item_id, case when r and not e then 'review' when r then 'review_with_data' else 'research_article' end as kind, case when r and not e then 0.7 when r then 0.85 else 1.0 end::double as factor from f"""
)
def paper_types(spark, sf_dir):
    turn = F.col("item_id") % 3
    full = F.concat("text", F.when(turn == 0, " a literature review of results").when(turn == 1, " an overview").otherwise(" experimental"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", screening.paper_type(full).alias("kind"))
    return rows.withColumn("factor", screening.review_factor(F.col("kind")))


@query(
    """with w as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents),
t(term, strength, attribute) as (values ('the', 'primary', 'a'), ('und', 'secondary', 'b'), ('de', 'alias', 'c'))
select doc_id, term, strength, attribute, count(*) as n from w join t using (term) group by all"""
)
def term_occurrences(spark, sf_dir):
    terms = spark.createDataFrame([("the", "primary", "a"), ("und", "secondary", "b"), ("de", "alias", "c")], "term string, strength string, attribute string")
    hits = screening.term_hits(table(spark, sf_dir, "documents"), "doc_id", "text", F.broadcast(terms))
    return hits.groupBy("doc_id", "term", "strength", "attribute").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""with t(term, strength, attribute) as (values ('of the', 'primary', 'a'), ('and the', 'secondary', 'b'), ('the', 'alias', 'c')),
d as (select doc_id, lower(text) as low from documents)
select doc_id, term, strength, attribute, n from (select doc_id, term, strength, attribute,
  case when contains(term, ' ') then len(regexp_extract_all(regexp_replace(low, '[^\p{L}\p{N}_]', '\0\0', 'g'), '(?:^|[^\p{L}\p{N}_])' || replace(term, ' ', '  ') || '(?:[^\p{L}\p{N}_]|$)'))
  else len(list_filter(string_split_regex(low, '[^a-z0-9]+'), lambda x: x = term)) end as n from d, t) where n > 0"""
)
def phrase_occurrences(spark, sf_dir):
    terms = spark.createDataFrame([("of the", "primary", "a"), ("and the", "secondary", "b"), ("the", "alias", "c")], "term string, strength string, attribute string")
    hits = screening.term_hits(table(spark, sf_dir, "documents"), "doc_id", "text", F.broadcast(terms))
    return hits.groupBy("doc_id", "term", "strength", "attribute").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with w as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term, generate_subscripts(string_split_regex(lower(text), '[^a-z0-9]+'), 1) - 1 as word from documents)
select a.doc_id, count(*) filter (abs(a.word - b.word) <= 15) as strong, count(*) filter (abs(a.word - b.word) > 15) as weak
from w a join w b on a.doc_id = b.doc_id and abs(a.word - b.word) <= 45 where a.term = 'with' and b.term = 'by' group by 1"""
)
def keyword_measurement_proximity(spark, sf_dir):
    terms = spark.createDataFrame([("with", "primary", "a"), ("by", "measurement", "b")], "term string, strength string, attribute string")
    hits = screening.term_hits(table(spark, sf_dir, "documents"), "doc_id", "text", F.broadcast(terms)).select("doc_id", "strength", "word")
    return screening.proximity(hits.filter("strength = 'primary'").drop("strength"), hits.filter("strength <> 'primary'").drop("strength"), "doc_id")


@query("select d.doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1) or not exists (select 1 from labels where quality = 1)")
def include_semijoin_fallback(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return screening.included_or_all(table(spark, sf_dir, "documents").select("doc_id"), good, "doc_id")


@query("select doc_id from documents")
def include_fallback_all(spark, sf_dir):
    """Nothing is included, so everything is."""
    none = table(spark, sf_dir, "labels").filter("quality = 7")
    return screening.included_or_all(table(spark, sf_dir, "documents").select("doc_id"), none, "doc_id")


@query(
    """select d.doc_id, coalesce('[' || cast(l.quality as varchar) || ',7]', '[1,2,3]') as pages from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)"""
)
def routing_default_pages(spark, sf_dir):
    routed = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.array("q", F.lit(7)).alias("text_pages"))
    out = pages.routed_or_default(table(spark, sf_dir, "documents"), routed, "doc_id")
    return out.select("doc_id", F.concat(F.lit("["), F.array_join("pages", ","), F.lit("]")).alias("pages"))


@query(
    """select c_custkey, len(list_intersect([c_custkey % 5, c_custkey % 7, c_nationkey], [c_custkey % 3, c_nationkey % 4, 2])) as shared,
  least(0.30, 0.10 * len(list_intersect([c_custkey % 5, c_custkey % 7, c_nationkey], [c_custkey % 3, c_nationkey % 4, 2])))::double as score from customer"""
)
def shared_attributes(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    shared = F.size(F.array_intersect(F.array(k % 5, k % 7, n), F.array(k % 3, n % 4, F.lit(2).cast("long")))).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", shared.alias("shared"), screening.attribute_score(shared).alias("score"))
