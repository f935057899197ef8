"""RSS and Atom feeds as a text column; documents with a DTD or entities are refused before parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, text

_ENTRY = "link string, guid string, id string, title string, encoded string, description string, summary string, content string, pubDate string, date string, published string, updated string, creator string, author string, category string, location string"


def unsafe(document: Column) -> Column:
    return F.rlike(document, F.lit(r"(?i)<!DOCTYPE|<!ENTITY"))


def entries(feeds: DataFrame, source: str, company: str | None = None) -> DataFrame:
    """Raw records of feeds (document string): items or entries, with fallbacks for id, body and date."""
    plain = feeds.filter(~unsafe(F.col("document"))).select(F.regexp_replace("document", r"(</?)(?:dc|content|atom|media):", "$1").alias("document"))
    links = F.regexp_replace("document", r"<link\b[^>]*\bhref=[\"']([^\"']*)[\"'][^>]*/>", "<link>$1</link>")
    blocks = plain.select(F.explode(F.regexp_extract_all(links, F.lit(r"(?s)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))).alias("block"))
    parsed = blocks.select(F.from_xml("block", _ENTRY).alias("e")).select("e.*")
    link = F.nullif(F.trim("link"), F.lit(""))
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    out = parsed.select(
        F.lit(source).alias("source"), F.lit("rss").alias("source_kind"), F.substring(F.coalesce(first("guid", "id"), link), 1, 256).alias("source_job_id"), link.alias("url"),
        F.nullif(text.clean_text(F.col("title"), most=512), F.lit("")).alias("title"),
        F.nullif(text.clean_text(first("encoded", "description", "summary", "content"), True, 200_000), F.lit("")).alias("description"),
        F.coalesce(F.nullif(text.clean_text(first("creator", "author"), most=256), F.lit("")), F.lit(company)).alias("company"),
        F.nullif(text.clean_text(F.col("location"), most=256), F.lit("")).alias("location"), F.nullif(text.clean_text(F.col("category"), most=128), F.lit("")).alias("industry"),
        dates.parse_datetime(first("pubDate", "date", "published", "updated")).alias("published_at"),
    )
    return out.filter("source_job_id IS NOT NULL")
