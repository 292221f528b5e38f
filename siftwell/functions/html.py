"""Parts of pages. What needs a parse comes from ``tree``, once a page; the rest are expressions."""

from __future__ import annotations

import html as standard
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .patterns import matching
from .tree import parts


def unescape(c: Column) -> Column:
    """Character references decoded as HTML5 names them, with or without a semicolon. Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: standard.unescape(t) if t and "&" in t else t)

    return run(c)


def unescape_all(c: Column) -> Column:
    """``unescape`` for each text of an array."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: x if x is None else [t and standard.unescape(t) for t in x])

    return run(c)


def title(html: Column) -> Column:
    """Text of the first title; an empty string without one."""
    return parts(html)["title"]


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, noscript and comments, white space collapsed."""
    return parts(html)["text"]


def section_text(html: Column, tag: str, most: int) -> Column:
    """Text of the first such element (footer or header), cut to so many characters; without one, that of the first element whose
    class holds the name."""
    return F.left(parts(html)[tag], F.lit(most))


def meta(html: Column) -> Column:
    """name or property -> content; the last of equal names counts."""
    return parts(html)["meta"]


def description(html: Column) -> Column:
    return F.left(F.coalesce(meta(html)["description"], F.lit("")), F.lit(500))


def json_ld_blocks(html: Column) -> Column:
    return parts(html)["json_ld"]


def has_json_ld(html: Column) -> Column:
    return F.exists(json_ld_blocks(html), lambda b: F.try_parse_json(b).isNotNull())


def open_graph(html: Column) -> Column:
    found = F.map_filter(meta(html), lambda k, _: k.startswith("og:"))
    return F.transform_values(F.transform_keys(found, lambda k, _: F.replace(k, F.lit("og:"), F.lit(""))), lambda _, v: F.left(v, F.lit(500)))


def social_links(html: Column) -> Column:
    """platform -> first profile link, without slashes at its end and query."""
    entries = [F.struct(F.lit(p).alias("k"), F.substring_index(F.regexp_replace(F.regexp_extract(html, rx, 0), "/+$", ""), "?", 1).alias("v")) for p, rx in C.SOCIAL.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] != ""))


def technologies(html: Column, headers: Column | None = None) -> Column:
    """array<struct<name, category, detection>>: page rules in order, then header rules; the first of a name counts."""
    one = lambda n, c, d: F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(d).alias("detection"))
    rules = F.array(*[one(n, c, "html") for n, c, _ in C.TECHNOLOGIES])
    found = F.transform(matching(html, [rx for *_, rx in C.TECHNOLOGIES]), lambda i: F.get(rules, i))
    if headers is None:
        return found  # page rules have a name each
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    hits = [F.when(F.map_contains_key(low, header) & (F.lower(low[header]).contains(part) if part else F.lit(True)), one(n, c, "header")) for n, c, header, part in C.HEADER_TECHNOLOGIES]
    # one pass over the hits, which are looked for once
    nothing = F.array().cast("array<struct<name:string,category:string,detection:string>>")
    return F.aggregate(F.concat(found, F.array_compact(F.array(*hits))), nothing, lambda names, x: F.when(F.exists(names, lambda y: y["name"] == x["name"]), names).otherwise(F.concat(names, F.array(x))))


PHONE = r"(?:\+?1[\s.\-]?)?(?:\(([2-9]\d{2})\)|([2-9]\d{2}))[\s.\-]?([2-9]\d{2})[\s.\-]?(\d{4})"


def phones(text: Column) -> Column:
    """North American numbers as +1.., the first of equal ones: an approximation of a full numbering plan. Digits on
    either side rule a match out, as in card numbers."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|[^\d.])({PHONE})(?:$|[^\d.]|\.(?:$|\D))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("+1"), F.right(F.regexp_replace(x, r"\D", ""), F.lit(10)))))


def copyright_year(footer: Column) -> Column:
    return F.regexp_extract(footer, C.COPYRIGHT_YEAR, 1).try_cast("int")
