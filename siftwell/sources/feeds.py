"""Sitemaps, robots.txt and feeds that were collected as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import unescape, unescape_all
from ..functions.text import strip
from ..operators.enrichment import contact_first

_LOC = r"(?s)<(?:[\w\-]+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:[\w\-]+:)?loc>"


def sitemap_urls(xml: Column, most: int = 50) -> Column:
    """Safe URLs of the ``loc`` elements, with or without a namespace, in order. A text that does not close its root gives none; an index
    file is not followed."""
    whole = xml.rlike(r"(?s)</(?:[\w\-]+:)?(?:urlset|sitemapindex)>\s*$")
    found = unescape_all(F.transform(F.regexp_extract_all(xml, F.lit(_LOC), F.lit(1)), strip))
    good = F.filter(found, lambda u: (u != "") & U.is_safe(u))
    return F.when(F.coalesce(whole, F.lit(False)), F.slice(good, 1, most)).otherwise(F.array().cast("array<string>"))


def robots_sitemap(text: Column) -> Column:
    """Target of the first ``Sitemap:`` line that starts with http; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?im)^sitemap:[ \t]*(http\S*)", 1), F.lit(""))


def best_sitemap(sources: DataFrame, key: str, priority: str, xml: Column, most: int = 50) -> DataFrame:
    """key and pages: of the sitemap of least priority number that lists any, contact pages first."""
    listed = sources.withColumn("pages", sitemap_urls(xml, most)).where(F.size("pages") > 0)
    return listed.groupBy(key).agg(F.min_by("pages", priority).alias("pages")).withColumn("pages", contact_first(F.col("pages"), most))


def feed(xml: Column) -> Column:
    """struct of title, description, link: of RSS, over which Atom's title goes."""
    inner = lambda tag, c: F.nullif(strip(unescape(F.regexp_extract(c, rf"(?is)<{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1))), F.lit(""))
    head = F.regexp_replace(xml, r"(?is)<(item|entry)[\s>].*", "")
    atom = F.when(xml.rlike(r"(?i)<feed[\s>]"), inner("title", head))
    rss = F.when(xml.rlike(r"(?i)<channel[\s>]"), F.lit(True))
    return F.struct(F.coalesce(atom, F.when(rss, inner("title", head))).alias("title"), F.when(rss, inner("description", head)).alias("description"), F.when(rss, inner("link", head)).alias("link"))


def feed_url(html: Column) -> Column:
    """href of the first alternate link whose type is a feed's."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?is)rel\s*=\s*["'][^"']*alternate""") & t.rlike(r"""(?is)type\s*=\s*["'][^"']*(?:rss|atom)"""))
    return F.nullif(F.regexp_extract(F.try_element_at(links, F.lit(1)), r"""(?is)href\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def text_pages(files: DataFrame, engine: str) -> DataFrame:
    """Texts that a PDF or OCR engine gave, files(url, parts array<string>), as pages: blank parts dropped, joined by line feeds."""
    parts = F.filter("parts", lambda p: strip(p) != "")
    return files.select("url", F.array_join(parts, "\n").alias("html"), F.lit(engine).alias("engine"), (F.size(parts) > 0).alias("success"))
