"""Relevance and screening of documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import word_end, word_start
from lodestone.operators.band import band_join

# fixed values: markers of paper types and the gates
REVIEW = ("review", "survey", "meta-analysis", "systematic review", "literature review", "overview", "perspective")
EXPERIMENTAL = ("experimental", "methodology", "characterization", "synthesis", "electrochemical", "results", "fabrication")
RELEVANCE_GATE, SCREENING_GATE = 0.35, 0.40
MAX_TERMS = 20_000  # as many terms are literals and a broadcast; more are joined


def _word(term: str) -> str:
    """The term between boundaries; the words of a longer one in order with at most four words between."""
    words = term.lower().split()
    return word_start("".join(words)) + r"(?:\W+\w+){0,4}?\W+".join(map(re.escape, words)) + word_end("".join(words))


def _count(flags: Sequence[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for flag, weight in flags:
        out = out + F.when(flag, weight).otherwise(0)
    return out


def relevance(text: Column, primary: Sequence[str], secondary: Sequence[str], query: str = "", units: Sequence[str] = ()) -> Column:
    """.25 query + .25 keywords + .25 technical terms + .15 numbers with units + .10 domain; 0 without a primary keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {k: low.rlike(_word(k)) for k in dict.fromkeys(k.lower().strip() for k in primary) if k}
    matched = _count([(hit, 2 if " " in k else 1) for k, hit in hits.items()] + [(low.rlike(_word(k)), 1) for k in secondary])
    technical = _count([(hit, 1) for k, hit in hits.items() if " " in k or len(k) > 5])
    terms = [w for w in query.lower().split() if len(w) > 3]
    asked = _count([(low.rlike("|".join(map(re.escape, terms))), 1)]) if terms else F.lit(0)
    unit = "|".join(re.escape(u.lower()) + word_end(u) for u in units)
    numeric = _count([(low.rlike(rf"{word_start('0')}\d+(?:\.\d+)?[\t\n\f\r ]*(?:{unit})"), 1)]) if units else F.lit(0)
    score = 0.25 * asked + 0.25 * F.least(F.lit(1.0), matched / 3.0) + 0.25 * F.least(F.lit(1.0), technical / 2.0) + 0.15 * numeric + 0.1
    domain = _count([(hit, 1) for hit in hits.values()]) > 0
    return F.when(domain, F.least(F.lit(1.0), score)).otherwise(0.0)


def paper_type(text: Column) -> Column:
    low = F.lower(text)
    review, data = (low.rlike("|".join(map(re.escape, m))) for m in (REVIEW, EXPERIMENTAL))
    return F.when(review & ~data, "review").when(review, "review_with_data").otherwise("research_article")


def review_factor(kind: Column) -> Column:
    return F.when(kind == "review", 0.7).when(kind == "review_with_data", 0.85).otherwise(1.0)


def keyword_score(primary: Column, alias: Column, secondary: Column) -> Column:
    return F.least(F.lit(0.40), 0.12 * primary + 0.08 * alias + 0.04 * secondary)


def numeric_score(attributes: Column, measurements: Column) -> Column:
    return F.least(F.lit(0.20), 0.07 * attributes) + F.least(F.lit(0.10), 0.03 * F.log1p(measurements))


def attribute_score(shared: Column) -> Column:
    return F.least(F.lit(0.30), 0.10 * shared)


def proximity_score(strong: Column, weak: Column) -> Column:
    """Bonus of at most .1: strong pairs (within 15 words) count .4, weak ones (within 45) .1 and three tenths of that."""
    return F.least(F.lit(0.10), 0.10 * F.least(F.lit(1.0), F.least(F.lit(1.0), strong * 0.4) + 0.3 * F.least(F.lit(0.5), weak * 0.1)))


def final_score(primary, alias, secondary, attributes, measurements, shared, strong, weak, kind) -> Column:
    """The parts together, at most 1, times the review factor; 0 without any primary or alias hit."""
    raw = keyword_score(primary, alias, secondary) + numeric_score(attributes, measurements) + attribute_score(shared) + proximity_score(strong, weak)
    score = F.round(F.least(F.lit(1.0), raw) * review_factor(kind), 3)
    return F.when((primary + alias) > 0, score).otherwise(0.0)


def term_hits(docs: DataFrame, key: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(key, term, strength, attribute, word): every occurrence of a term, by the index of its first word.

    The text is split once into words (a-z, 0-9) and what separates them. Runs of as many words as a term has, with
    the separators between them, meet the terms in an equi-join, so the cost grows with the number of different lengths
    of terms and not with the number of terms. Up to MAX_TERMS terms are broadcast and only runs that begin with the first
    word of a term are made; beyond, all runs are. Other characters at a term's ends are held against the separators around
    the run. A term of several words or with other characters must stand between word boundaries; a plain word is one
    between separators. Case doesn't count. A term without any of a-z and 0-9 is an error. ``terms`` is (term, strength,
    attribute) and other columns to keep."""
    core = F.regexp_extract(F.lower("term"), r"(?s)[a-z0-9](?:.*[a-z0-9])?", 0)
    core = F.when(core == "", F.raise_error(F.concat(F.lit("no letter a-z or digit in the term "), F.col("term")))).otherwise(core)
    named = terms.select("*", F.lower("term").alias("_low"), core.alias("_core"))
    at = F.instr("_low", F.col("_core"))
    named = named.select("*", F.substring("_low", F.lit(1), at - 1).alias("_lead"), F.substring("_low", at + F.length("_core"), F.length("_low")).alias("_trail"))
    named = named.withColumns({"_n": F.regexp_count("_core", F.lit("[a-z0-9]+")), "_plain": F.col("_low").rlike("^[a-z0-9]+$")})
    shapes = named.select("_n", "_plain", F.regexp_extract("_core", "^[a-z0-9]+", 0).alias("_first"))
    heads = shapes.limit(MAX_TERMS + 1).collect()
    few = len(heads) <= MAX_TERMS
    if not few:
        heads = shapes.groupBy("_n").agg(F.min("_plain").alias("_plain")).collect()
    out = [key, *terms.columns, "word"]
    met = lambda runs: runs.join(F.broadcast(named) if few else named, "_core")
    begins = lambda word, n: word.isin(sorted({r["_first"] for r in heads if r["_n"] == n}))
    low = F.lower(text_col)
    if not heads:
        return docs.join(terms, F.lit(False)).select(key, *terms.columns, F.lit(0).alias("word"))
    if all(r["_plain"] for r in heads):
        words = docs.select(key, F.posexplode(F.split(low, "[^a-z0-9]+")).alias("word", "_core"))
        return met(words.filter(begins(F.col("_core"), 1)) if few else words).select(*out)
    split = docs.select(key, F.split(low, "[^a-z0-9]+").alias("_t"), F.regexp_extract_all(low, F.lit("[^a-z0-9]+"), F.lit(0)).alias("_s"))
    nothing = F.array().cast("array<struct<word:int,_core:string,_before:string,_after:string>>")

    def runs(n: int) -> Column:
        def run(i: Column) -> Column:
            parts = [F.get("_t", i)]
            for j in range(1, n):
                parts += [F.get("_s", i + (j - 1)), F.get("_t", i + j)]
            # the separators around the run, with the letters beyond them
            before = F.coalesce(F.concat(F.right(F.get("_t", i - 1), F.lit(1)), F.get("_s", i - 1)), F.lit(""))
            after = F.coalesce(F.concat(F.get("_s", i + (n - 1)), F.left(F.get("_t", i + n), F.lit(1))), F.lit(""))
            return F.struct(i.alias("word"), F.concat(*parts).alias("_core"), before.alias("_before"), after.alias("_after"))

        at = F.sequence(F.lit(0), F.size("_t") - n)
        return F.when(F.size("_t") >= n, F.transform(F.filter(at, lambda i: begins(F.get("_t", i), n)) if few else at, run)).otherwise(nothing)

    before = F.expr("substring(_before, 1, length(_before) - length(_lead))")
    after = F.expr("substring(_after, length(_trail) + 1)")
    within = (F.col("_low").rlike(r"^[\p{L}\p{N}_]") & before.rlike(r"[\p{L}\p{N}_]$")) | (F.col("_low").rlike(r"[\p{L}\p{N}_]$") & after.rlike(r"^[\p{L}\p{N}_]"))
    bounded = F.endswith("_before", "_lead") & F.startswith("_after", "_trail") & ~within
    # a run meets terms of its own length only: the words in it are those of the term
    lengths = sorted({r["_n"] for r in heads})
    return met(split.select(key, F.inline(F.concat(*map(runs, lengths))))).filter(F.col("_plain") | bounded).select(*out)


def proximity(hits: DataFrame, measurements: DataFrame, key: str, words: int = 15) -> DataFrame:
    """(key, strong, weak): pairs of a hit and a measurement within ``words`` and within three times as many."""
    pairs = band_join(hits.withColumnRenamed("word", "_h"), measurements.withColumnRenamed("word", "_m"), [key], "_h", "_m", 3 * words)
    near = F.abs(F.col("_h") - F.col("_m")) <= words
    return pairs.groupBy(key).agg(F.count_if(near).alias("strong"), F.count_if(~near).alias("weak"))


def included_or_all(files: DataFrame, included: DataFrame, key: str, fallback: bool = True) -> DataFrame:
    """Files that screening includes; all of them if it includes none and ``fallback`` is on."""
    some = files.join(included.select(key).distinct(), key, "left_semi")
    if not fallback:
        return some
    none = included.limit(1).agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return some.unionByName(files.filter(none))


def strength_counts(hits: DataFrame, key: str) -> DataFrame:
    """(key, primary, alias, secondary): hits of each strength."""
    return hits.groupBy(key).agg(*[F.count_if(F.col("strength") == s).alias(s) for s in ("primary", "alias", "secondary")])


def gated(df: DataFrame, text_col: str, score_col: str, least: float = SCREENING_GATE, characters: int = 50) -> DataFrame:
    """``df`` with ``enough`` (the trimmed text has so many characters) and ``include`` (enough, and a score of ``least`` or
    more); without enough text the score is 0."""
    enough = F.coalesce(F.length(F.trim(F.col(text_col))) >= characters, F.lit(False))
    scored = df.withColumn("enough", enough).withColumn(score_col, F.when(F.col("enough"), F.col(score_col)).otherwise(0.0))
    return scored.withColumn("include", F.col("enough") & (F.col(score_col) >= least))


def triggered_aliases(docs: DataFrame, key: str, text_col: str, aliases: DataFrame, keyword_hits: DataFrame, letters: int = 5) -> DataFrame:
    """Hits of aliases (term, strength, attribute, ordinal) of those attributes that a document's keywords bring up; in
    documents without a keyword, of all aliases with so many letters. Where a keyword stands there is no alias, and at one
    place only the first alias counts."""
    found = term_hits(docs, key, text_col, aliases.select("term", "strength", "attribute", "ordinal")).withColumn("_keyword", F.lit(False))
    keywords = keyword_hits.filter(F.col(key).isNotNull()).select(key, "attribute", "word", F.lit(True).alias("_keyword"))
    keyword = lambda *of: F.max("_keyword").over(Window.partitionBy(key, *of))
    rows = found.unionByName(keywords, allowMissingColumns=True)
    rows = rows.withColumns({"_any": keyword(), "_brought": keyword("attribute") & F.col("attribute").isNotNull(), "_taken": keyword("word")})
    free = rows.filter(~F.col("_taken") & F.when(F.col("_any"), F.col("_brought")).otherwise(F.length("term") >= letters))
    first = F.row_number().over(Window.partitionBy(key, "word").orderBy("ordinal"))
    return free.withColumn("_r", first).filter("_r = 1").select(key, "term", "strength", "attribute", "word")


def ordered_distinct(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the different values in the order in which they first occur."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("values"))


def leading(values: str, n: int) -> Column:
    """The first n of an array: hits, measurements or pairs of a report."""
    return F.slice(values, 1, n)
