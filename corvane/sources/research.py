"""Research sources out of payloads that fetchers delivered: feeds, JSON, pages and extracted PDF text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ATOM = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"
_PAPERS = "data array<struct<paperId:string,title:string,abstract:string,year:int,citationCount:int,url:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string,ArXiv:string>>>"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def from_atom(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Sources of an Atom feed."""
    e = payloads.select(F.explode(F.from_xml(F.col(column), _ATOM, {"rowTag": "feed"})["entry"]).alias("e"))
    ident = T.arxiv_id(F.col("e.id"))
    return e.select(
        ident.alias("source_id"), F.lit("arxiv").alias("source_type"), _squeezed(F.col("e.title")).alias("title"), F.col("e.author.name").alias("authors"),
        _squeezed(F.col("e.summary")).alias("abstract"), F.col("e.id").alias("url"), F.lit(None).cast("string").alias("doi"),
        F.substring("e.published", 1, 4).try_cast("int").alias("year"), F.lit(None).cast("int").alias("citation_count"),
    )


def from_paper_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Sources of a paper service's JSON; malformed payloads give none."""
    e = payloads.select(F.explode(F.from_json(F.col(column), _PAPERS)["data"]).alias("e"))
    return e.select(
        F.col("e.paperId").alias("source_id"), F.lit("paper").alias("source_type"), F.col("e.title").alias("title"), F.col("e.authors.name").alias("authors"),
        F.col("e.abstract").alias("abstract"), F.col("e.url").alias("url"), F.col("e.externalIds.DOI").alias("doi"), F.col("e.year").alias("year"), F.col("e.citationCount").alias("citation_count"),
    )


def from_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    h = F.col(html)
    return pages.select(
        F.sha2(url, 256).alias("source_id"), F.lit("web").alias("source_type"), F.coalesce(T.html_title(h), F.col(url)).alias("title"),
        F.when(T.html_author(h).isNotNull(), F.array(T.html_author(h))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.substring(T.html_text(h), 1, 500).alias("abstract"), F.col(url).alias("url"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("citation_count"),
    )


def pdf_pages(texts: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """(keep..., page, content): pages of extracted text, apart by form feeds, blank ones left out."""
    df = texts.select(*keep, F.posexplode(F.split(column, "\f")).alias("k", "content"))
    return df.filter(F.trim("content") != "").select(*keep, (F.col("k") + 1).alias("page"), "content")


def dispatch(urls: DataFrame, column: str = "url") -> DataFrame:
    """urls with `fetcher`, the first that takes each one."""
    u = F.lower(F.col(column))
    kind = F.when(F.contains(u, F.lit("arxiv.org")), "arxiv").when(F.contains(u, F.lit("semanticscholar.org")), "paper").when(F.endswith(u, F.lit(".pdf")), "pdf").when(u.rlike("^https?://"), "web")
    return urls.withColumn("fetcher", kind)


#: What makes sources of a fetcher's payloads; each takes rows (url, payload).
FETCHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "arxiv": from_atom,
    "paper": from_paper_json,
    "web": lambda rows: from_pages(rows, "url", "payload"),
}


def fetched(payloads: DataFrame) -> DataFrame:
    """Sources of rows (url, payload), each by the first fetcher that takes its address; addresses that none takes give none."""
    rows = dispatch(payloads)
    return everything([parse(rows.filter(F.col("fetcher") == name).drop("fetcher")) for name, parse in FETCHERS.items()])


def everything(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
