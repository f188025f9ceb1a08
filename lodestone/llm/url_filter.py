"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a host and a path prefix, e.g. ``example.com/de/``: it fits that host and its subdomains. Rules become
regular expressions over host + path. Every maximal run of letters and digits of a rule that is bounded on both
sides must occur as a token of any URL that fits, so each rule is filed under one such token: the one that the
fewest URLs contain. A URL looks up its own tokens, and only the rules found that way run their expression.
Rules without a bounded token are candidates for every URL.

Work is done once per distinct URL, so a page repeated a million times costs one evaluation; the verdicts are
joined back by URL. Only DataFrame operations are used.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import fresh

BROADCAST_RULES = 20_000  # rule lists up to this length are broadcast (a few MB); longer ones are shuffled
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _compiled(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, list[str]]]:
    """For each (action, rule): rule, action, regex and the literal tokens by which the rule can be filed."""
    rows = []
    for action, rule in dict.fromkeys(rules):
        host, _, path = rule.partition("/")
        whole = f"{host.translate(str.maketrans(UPPER, LOWER))}/{path}"
        # a token counts only if the pattern bounds it: the last one may go on in the URL's path
        tokens = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", whole)
        rows.append((rule, action, rf"(?s)^(?:[^/]*\.)?{''.join(re.escape(c) for c in whole)}", tokens))
    return rows


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda t: t != ""))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The input with host, path, rule and verdict added (existing columns of these names are replaced).

    The longest rule that fits wins, equal lengths by the smaller text. Without a rule (null and malformed URLs
    too) ``rule`` is null and the verdict is ``default``. URLs of any length are judged whole; repeated rows keep their
    number; other columns stay, whatever their names; an empty table stays empty.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(_compiled(rules), "rule string, action string, regex string, tokens array<string>")
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)

    urls = df.select(F.col(url_col).alias("_url")).filter(F.col("_url").contains("://")).distinct()
    urls = urls.withColumn("_target", F.concat(url_host(F.col("_url")), url_path(F.col("_url"))))
    tokens = urls.select("_url", "_target", F.explode(_tokens(F.col("_target"))).alias("token"))

    literals = table.select(F.explode("tokens").alias("token"), "rule", "action", "regex")
    seen = tokens.join(hint(literals.select("token").distinct()), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # as many rows as the rules have tokens
    ranked = literals.join(hint(counts), "token", "left").groupBy("rule", "action", "regex")
    index = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")).select("rule", "action", "regex", F.col("best.token").alias("token"))

    found = tokens.join(hint(index), "token").drop("token")
    loose = [(rule, action, regex) for rule, action, regex, tokens in _compiled(rules) if not tokens]
    if loose:
        listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"), F.lit(x).alias("regex")) for r, a, x in loose])
        found = found.unionByName(urls.select("_url", "_target", F.explode(listed).alias("r")).select("_url", "_target", "r.*"))
    fitting = found.filter(F.expr("_target rlike regex"))
    key, found = fresh(df, "judged_url"), fresh(df, "judged")
    best = fitting.groupBy(F.col("_url").alias(key)).agg(F.min(F.struct((-F.length("rule")).alias("l"), "rule", "action")).alias(found))
    plain = df.drop("host", "path", "rule", "verdict") if url_col not in ("host", "path", "rule", "verdict") else df
    # a URL of very many rows is split by the skew join of adaptive execution: only the other side has it once
    return plain.join(best, plain[url_col] == best[key], "left").select(
        *[plain[c] for c in plain.columns],
        url_host(plain[url_col]).alias("host"),
        url_path(plain[url_col]).alias("path"),
        best[found]["rule"].alias("rule"),
        F.coalesce(best[found]["action"], F.lit(default)).alias("verdict"),
    )
