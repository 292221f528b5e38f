"""Addresses found on pages, with how and in which order they were found.

A page is read in two passes, over its parsed parts and over its raw HTML, each with its strategies in a fixed order; the first
occurrence of an address wins within a pass, within a page and within a company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import emails as E
from ..functions import html as H
from ..functions.text import clean_address, stable_hash

#: (pass, strategy, method); the order in which occurrences count.
RAW_STRATEGIES = [
    (2, 6, "javascript", E.in_scripts),
    (2, 7, "html_comment", E.in_comments),
    (2, 8, "base64", E.in_base64),
    (2, 9, "unicode_obfuscation", E.obfuscated),
    (2, 10, "cloudflare_decode", E.cloudflare),
]


def found(method: str, pass_no: int, strategy: int, values: Column) -> Column:
    """An array of finds, in the order of their matches."""
    return F.transform(
        values,
        lambda x, i: F.struct(
            F.lit(pass_no).alias("pass_no"), F.lit(strategy).alias("strategy_no"), i.cast("int").alias("match_no"), clean_address(x).alias("address"), F.lit(method).alias("method"), F.lit(C.METHOD_HINT[method]).alias("hint")
        ),
    )


def raw_finds(html: Column) -> Column:
    return F.filter(F.concat(*[found(m, p, s, scan(html)) for p, s, m, scan in RAW_STRATEGIES]), lambda x: x["address"].rlike(r"@[^@]*\.[^@]*$"))


def page_parts(html: Column) -> dict[str, Column]:
    """What the first pass reads of a page: parts of one parse."""
    return {"part_mailto": E.mailto(html), "part_text": H.visible_text(html), "part_footer": H.section_text(html, "footer", 5000), "part_header": H.section_text(html, "header", 2000)}


def parsed_finds(schema_addresses: Column | None = None) -> Column:
    """Over ``page_parts``: mailto links, visible text, footer, header and, if given, addresses of JSON-LD."""
    parts = [
        found("mailto", 1, 1, F.col("part_mailto")),
        found("html_regex", 1, 2, F.concat(F.col("part_mailto"), E.scan_quoted(F.col("part_text")))),
        found("footer", 1, 3, E.scan(F.col("part_footer"))),
        found("header", 1, 4, E.scan(F.col("part_header"))),
    ]
    if schema_addresses is not None:
        parts.append(found("schema_ld", 1, 5, schema_addresses))
    return F.filter(F.concat(*parts), lambda x: x["address"].contains("@"))


def explode_finds(pages: DataFrame, html: Column, schema_addresses: Column | None = None) -> DataFrame:
    """pages plus a row for each find; pages whose HTML cannot hold an address are not searched."""
    may = html.contains("@") | html.rlike("(?i)&(?:#0*64\\b|#x0*40\\b|commat;)") | F.lower(html).rlike(r"cfemail|email-protection|\bat\b|\[at\]|\(at\)|\{at\}|＠") | html.rlike(C.BASE64)
    parts = pages.where(may).withColumns(page_parts(html))
    return parts.withColumn("find", F.explode(F.concat(parsed_finds(schema_addresses), raw_finds(html)))).select(*pages.columns, "find.*")


def from_text(texts: DataFrame, text: Column, method: str = "pdf_text") -> DataFrame:
    """Finds of plain text, such as that of PDF or OCR engines."""
    return texts.withColumn("find", F.explode(found(method, 1, 1, E.scan(text)))).select(*texts.columns, "find.*")


ORDER = ["pass_no", "strategy_no", "match_no"]


def first_on_page(finds: DataFrame, page: list[str]) -> DataFrame:
    """Within each pass of a page the first occurrence of an address; what a page counts as found."""
    w = Window.partitionBy(*page, "pass_no", "address").orderBy("strategy_no", "match_no")
    return finds.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first_occurrence(finds: DataFrame, company: str, page_order: str) -> DataFrame:
    """One row for each company and address: the first by page, pass, strategy and match. Scores play no part, so a weak
    first find hides a stronger later one. A minimum of a struct, so copies are combined before the shuffle."""
    rest = [c for c in finds.columns if c not in (company, "address", page_order, *ORDER)]
    least = F.min(F.struct(F.col(page_order), *[F.col(o) for o in ORDER], *[F.col(c) for c in rest])).alias("first")
    return finds.groupBy(company, "address").agg(least).select(company, "address", "first.*").withColumn("address_hash", stable_hash(F.col("address")))
