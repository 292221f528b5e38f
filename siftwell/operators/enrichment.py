"""What a company's pages say about it: issues, summaries, merged lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import html as H
from ..functions import urls as U


def issue_list(success: Column, final_url: Column, status: Column, duration_ms: Column, html: Column, footer: Column, has_contact: Column, as_of_year: int) -> Column:
    """array<struct<code, text>> of a home page, most important first; an unreachable one has this issue only."""
    issue = lambda code, text=None: F.struct(F.lit(code).alias("code"), (text if text is not None else F.lit(C.ISSUE_TEXT[code])).alias("text"))
    year = H.copyright_year(footer)
    meta = H.meta(html)
    checks = [
        F.when(~F.lower(final_url).startswith("https://"), issue("no_ssl")),
        F.when(status >= 400, issue("bad_status", F.concat(F.lit(C.ISSUE_TEXT["bad_status"]), status.cast("string")))),
        F.when(duration_ms > C.SLOW_MS, issue("slow_load", F.concat(F.lit(C.ISSUE_TEXT["slow_load"]), F.format_string("%.1f", duration_ms / 1000), F.lit("s)")))),
        F.when(H.title(html) == "", issue("no_title")),
        F.when(F.coalesce(meta["description"], F.lit("")) == "", issue("no_meta_description")),
        F.when(~F.map_contains_key(meta, "viewport"), issue("no_viewport")),
        F.when(~H.has_json_ld(html), issue("no_structured_data")),
        F.when(F.lit(as_of_year) - year >= 2, issue("outdated_copyright", F.concat(F.lit(C.ISSUE_TEXT["outdated_copyright"]), year.cast("string"), F.lit(")")))),
        F.when(~has_contact, issue("no_contact_page")),
    ]
    return F.when(F.coalesce(success, F.lit(False)), F.array_compact(F.array(*checks))).otherwise(F.array(issue("unreachable")))


def issue_summary(texts: Column, most: int = C.SUMMARY_CHARS) -> Column:
    """Texts joined by ``; `` as long as they fit; it stops at the first that does not."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("full"))

    def add(acc: Column, text: Column) -> Column:
        longer = F.when(acc["s"] == "", text).otherwise(F.concat(acc["s"], F.lit("; "), text))
        fits = ~acc["full"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["s"]).alias("s"), (~fits).alias("full"))

    return F.when(F.size(texts) == 0, C.NO_ISSUES).otherwise(F.aggregate(texts, start, add)["s"])


def business_summary(description: Column, services: Column, industry: Column, category: Column, none: str) -> Column:
    """Description, ``Services: ..`` (six at most) and ``Industry: ..``; ``none`` if there is nothing to say."""
    listed = F.slice(F.filter(F.coalesce(services, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")), 1, 6)
    kind = F.coalesce(F.nullif(industry, F.lit("")), F.nullif(category, F.lit("")))
    parts = F.array(
        F.nullif(F.trim(description), F.lit("")),
        F.when(F.size(listed) > 0, F.concat(F.lit("Services: "), F.array_join(listed, ", "), F.lit("."))),
        F.concat(F.lit("Industry: "), kind, F.lit(".")),
    )
    return F.coalesce(F.nullif(F.left(F.array_join(F.array_compact(parts), " "), F.lit(C.BUSINESS_CHARS)), F.lit("")), F.lit(none))


def state_of(address: Column) -> Column:
    return address["state"]


def union_in_order(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """One array of distinct values for each key, in the order in which they were first seen."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(F.struct(*order)).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", value)))
    return first.groupBy(*key).agg(F.transform(listed, lambda x: x[value]).alias(out))


def first_map(rows: DataFrame, key: Sequence[str], order: Column, entry_key: str, entry_value: str, out: str) -> DataFrame:
    """One map for each key; for each entry the value seen first."""
    best = rows.groupBy(*key, entry_key).agg(F.min_by(entry_value, order).alias("v"))
    return best.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(entry_key).alias("k"), "v")))).alias(out))


def usable(pages: DataFrame) -> DataFrame:
    """Pages that were fetched and have content; only these are read any further."""
    return pages.where(F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.col("html"), F.lit("")) != ""))


def first_page_facts(pages: DataFrame, company: str, order: Column, facts: Column) -> DataFrame:
    """company and facts: those of each company's first usable page, whatever later pages say."""
    return usable(pages).groupBy(company).agg(F.min_by(facts, order).alias("facts"))


def phones_of_company(stated: Column, found: Column) -> Column:
    """Numbers that the first page's structured data states, as they are written there, then those found in texts, each once."""
    return F.array_distinct(F.concat(F.coalesce(stated, F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>"))))


def engines_of_run(companies: DataFrame, engines: str) -> DataFrame:
    """One row: all engines that any company of a run used, sorted."""
    return companies.select(F.explode(engines).alias("engine")).distinct().agg(F.array_sort(F.collect_list("engine")).alias("engines"))  # a handful of names


def home_page(pages: DataFrame, company: str, url: Column, base: Column, order: Column) -> DataFrame:
    """The first page of each company whose URL is its base URL."""
    w = Window.partitionBy(company).orderBy(order)
    return pages.where(url == base).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def crawl_plan(base: Column, sitemap_pages: Column, most: int = 20) -> Column:
    """Home page, sitemap pages, known paths; each once, so many at most."""
    known = F.transform(F.array(*[F.lit(p) for p in C.KNOWN_PATHS]), lambda p: F.concat(F.rtrim(base, F.lit("/")), p))
    return F.slice(F.array_distinct(F.concat(F.array(base), F.coalesce(sitemap_pages, F.array().cast("array<string>")), known)), 1, most)


def site_pages(pages: DataFrame, base: str, url: str, most: int = 50) -> DataFrame:
    """base and urls: of each site the first ``most`` distinct safe pages, contact pages before the others, each in the order of their URLs.

    The best of a site are picked before the shuffle and again after it, so a site of any size is ``most`` rows a task; sites without
    a safe page have none.
    """
    distinct = pages.select(base, url).distinct()
    place = F.row_number().over(Window.partitionBy(base).orderBy(F.desc("_contact"), url))
    best = distinct.where(U.is_safe(F.col(url))).withColumn("_contact", U.is_contact_page(F.col(url))).withColumn("_place", place).where(F.col("_place") <= most)
    listed = best.groupBy(base).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", url))), lambda x: x[url]).alias("urls"))
    return distinct.select(base).distinct().join(listed, base, "left")


def contact_first(urls: Column, most: int = 50) -> Column:
    """Distinct safe URLs, contact pages before the others, each in the given order."""
    good = F.array_distinct(F.filter(urls, U.is_safe))
    return F.slice(F.concat(F.filter(good, U.is_contact_page), F.filter(good, lambda u: ~U.is_contact_page(u))), 1, most)
