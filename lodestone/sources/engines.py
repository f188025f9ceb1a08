"""Search engines' replies as paper rows: (title, authors, year, journal, doi, pdf).

Replies are fetched elsewhere and stored; these are scans over stored payloads (one reply per row, column
``payload``), so paging, retries and rate limits stay outside the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPER = ["title", "authors", "year", "journal", "doi", "pdf"]


def _rows(df: DataFrame, items: Column, fields: dict[str, Column]) -> DataFrame:
    exploded = df.select(F.explode(items).alias("r"))
    return exploded.select(*[fields.get(c, F.lit(None)).cast("string").alias(c) for c in PAPER])


def _r(name: str) -> Column:
    return F.col(f"r.{name}")


def arxiv(df: DataFrame) -> DataFrame:
    """Atom feeds: one row per entry."""
    entries = F.split(F.regexp_replace("payload", r"(?s)^.*?<entry>|</feed>.*$", ""), r"<entry>")
    e = F.col("r")
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract(e, rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"\s+", " "))
    names = F.array_join(F.regexp_extract_all(e, F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), F.lit(1)), ", ")
    pdf = F.nullif(F.regexp_extract(e, r'<link[^>]*title="pdf"[^>]*href="([^"]+)"', 1), F.lit(""))
    rows = df.filter(F.col("payload").contains("<entry>"))
    return _rows(rows, entries, {"title": tag("title"), "authors": names, "year": F.substring(tag("published"), 1, 4), "journal": F.lit("arXiv"), "doi": F.nullif(tag("arxiv:doi"), F.lit("")), "pdf": pdf})


def semantic_scholar(df: DataFrame) -> DataFrame:
    kind = "data array<struct<title: string, year: int, venue: string, authors: array<struct<name: string>>, externalIds: struct<DOI: string>, openAccessPdf: struct<url: string>>>"
    fields = {"title": _r("title"), "authors": F.array_join(_r("authors.name"), ", "), "year": _r("year"), "journal": _r("venue"), "doi": _r("externalIds.DOI"), "pdf": _r("openAccessPdf.url")}
    return _rows(df.select(F.from_json("payload", kind).alias("j")), F.col("j.data"), fields)


def europepmc(df: DataFrame) -> DataFrame:
    """Only open-access papers."""
    kind = "resultList struct<result: array<struct<title: string, authorString: string, pubYear: string, journalTitle: string, doi: string, pmcid: string, isOpenAccess: string>>>"
    open_ = F.filter("j.resultList.result", lambda r: r["isOpenAccess"] == "Y")
    pdf = F.when(_r("pmcid").isNotNull(), F.concat(F.lit("https://europepmc.org/articles/"), _r("pmcid"), F.lit("?pdf=render")))
    return _rows(df.select(F.from_json("payload", kind).alias("j")), open_, {"title": _r("title"), "authors": _r("authorString"), "year": _r("pubYear"), "journal": _r("journalTitle"), "doi": _r("doi"), "pdf": pdf})


def crossref(df: DataFrame) -> DataFrame:
    """The first link that is a PDF."""
    kind = (
        "message struct<items: array<struct<title: array<string>, author: array<struct<given: string, family: string>>, `container-title`: array<string>, DOI: string, "
        "issued: struct<`date-parts`: array<array<int>>>, link: array<struct<URL: string, `content-type`: string>>>>>"
    )
    pdf = F.get(F.filter(_r("link"), lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    names = F.array_join(F.transform(_r("author"), lambda a: F.concat_ws(" ", a["given"], a["family"])), ", ")
    fields = {
        "title": F.get(_r("title"), F.lit(0)), "authors": names, "year": F.get(F.get(_r("issued.`date-parts`"), F.lit(0)), F.lit(0)),
        "journal": F.get(_r("`container-title`"), F.lit(0)), "doi": _r("DOI"), "pdf": pdf,
    }
    return _rows(df.select(F.from_json("payload", kind).alias("j")), F.col("j.message.items"), fields)


def core(df: DataFrame) -> DataFrame:
    """Only papers with a download address."""
    kind = "results array<struct<title: string, authors: array<struct<name: string>>, yearPublished: int, publisher: string, doi: string, downloadUrl: string>>"
    some = F.filter("j.results", lambda r: F.coalesce(r["downloadUrl"], F.lit("")) != "")
    fields = {"title": _r("title"), "authors": F.array_join(_r("authors.name"), ", "), "year": _r("yearPublished"), "journal": _r("publisher"), "doi": _r("doi"), "pdf": _r("downloadUrl")}
    return _rows(df.select(F.from_json("payload", kind).alias("j")), some, fields)


def scholar_html(df: DataFrame) -> DataFrame:
    """Result pages: title, first address that is a PDF, year."""
    items = F.regexp_extract_all("payload", F.lit(r'(?s)<div class="gs_r[^"]*"[^>]*>(.*?)(?=<div class="gs_r|$)'), F.lit(1))
    e = F.col("r")
    title = F.trim(F.regexp_replace(F.regexp_extract(e, r'(?s)<h3[^>]*>(.*?)</h3>', 1), "<[^>]+>", ""))
    year = F.nullif(F.regexp_extract(e, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    pdf = F.nullif(F.regexp_extract(e, r'href="([^"]+\.pdf[^"]*)"', 1), F.lit(""))
    return _rows(df, items, {"title": title, "year": year, "pdf": pdf})


ENGINES = {"arxiv": arxiv, "semantic_scholar": semantic_scholar, "europepmc": europepmc, "crossref": crossref, "core": core, "scholar": scholar_html}


def valid_document(pages: DataFrame, key: str) -> DataFrame:
    """(key, valid): more than 50 characters on the first two pages, or at least four pages."""
    chars = F.sum(F.when(F.col("page") <= 2, F.length(F.trim("content"))).otherwise(0))
    return pages.groupBy(key).agg(((chars > 50) | (F.count(F.lit(1)) >= 4)).alias("valid"))
