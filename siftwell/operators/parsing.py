"""What pages say in structure: resolved links, microdata, addresses deep in JSON-LD, facts of the company.

The page itself is parsed once (``functions.tree``); its JSON-LD blocks are walked in Arrow batches, everything else is an expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import tree
from ..functions import urls as U

_OBJECTS = T.StructType([T.StructField("json_ld", T.ArrayType(T.StringType())), T.StructField("schema_addresses", T.ArrayType(T.StringType()))])
_EMAIL = re.compile(C.EMAIL)
_MAIL_KEYS = ("email", "contactemail", "contactpoint")


def _addresses(value: object) -> Iterator[str]:
    """Addresses under the mail keys of nested objects; an object that stands under such a key is not entered."""
    for key, v in value.items() if isinstance(value, dict) else ():
        if key.lower() in _MAIL_KEYS:
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, str):
                    yield from _EMAIL.findall(x)
                elif isinstance(v, list):
                    yield from _addresses(x)
        else:
            for x in v if isinstance(v, list) else [v]:
                yield from _addresses(x)


def read_objects(blocks: list[str]) -> tuple[list[str], list[str]]:
    """(objects of JSON-LD blocks, addresses in them: of typed ones, then of all). Blocks that are no JSON are passed over."""
    objects = []
    for block in blocks:
        try:
            data = json.loads(block)
        except (ValueError, RecursionError):
            continue
        objects += [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]
    typed = [x for x in objects if x.get("@type")]
    return [json.dumps(x, ensure_ascii=False) for x in objects], [a for x in [*typed, *objects] for a in _addresses(x)]


def read_page(html: str | None) -> dict:
    """The parts of one page (as ``parse_html`` gives them for a column)."""
    page = dict(zip(tree.PARTS.names, tree.read(html), strict=True))
    page["json_ld"], page["schema_addresses"] = read_objects(page["json_ld"])
    return page


@F.pandas_udf(_OBJECTS)
def _objects(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for lists in batches:
        yield pd.DataFrame([read_objects(x if x is not None else []) for x in lists], columns=_OBJECTS.names)


def parse_html(html: Column) -> Column:
    """struct<hrefs, images, json_ld, schema_addresses, microdata> of one parse a page."""
    page = tree.parts(html)
    said = _objects(page["json_ld"])
    return F.struct(page["hrefs"].alias("hrefs"), page["images"].alias("images"), said["json_ld"].alias("json_ld"), said["schema_addresses"].alias("schema_addresses"), page["microdata"].alias("microdata"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _join_urls(base: pd.Series, refs: pd.Series) -> pd.Series:
    def one(b: str, found: list[str]) -> list[str | None]:
        out = []
        for r in found if found is not None else []:
            try:
                out.append(urljoin(b, r.strip()))
            except ValueError:
                out.append(None)
        return out

    return pd.Series([one(b or "", r) for b, r in zip(base, refs, strict=True)])


def resolve(base: Column, refs: Column) -> Column:
    """References resolved against a page's URL; what is not a safe http URL then is left out."""
    return F.filter(_join_urls(base, refs), lambda u: u.isNotNull() & U.is_safe(u))


def with_parsed(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages plus ``parsed`` and links, pdf_links, image_links."""
    df = pages.withColumn("parsed", parse_html(F.col(html)))
    plain = F.filter("parsed.hrefs", lambda h: ~F.lower(h).startswith("mailto:"))
    pdf = lambda h: F.lower(h).endswith(".pdf")
    return (
        df.withColumn("links", resolve(F.col(url), F.filter(plain, lambda h: ~pdf(h))))
        .withColumn("pdf_links", resolve(F.col(url), F.filter(plain, pdf)))
        .withColumn("image_links", resolve(F.col(url), F.col("parsed.images")))
    )


def _first(items: Column, path: str, most: int | None = None) -> Column:
    values = F.filter(F.transform(items, lambda x: F.get_json_object(x, path)), lambda v: v.isNotNull() & (v != ""))
    value = F.try_element_at(values, F.lit(1))
    return F.left(value, F.lit(most)) if most else value


def company_facts(json_ld: Column, open_graph: Column, meta: Column, title: Column, description: Column) -> Column:
    """struct of name, description, address, phone_numbers, opening_hours, services, team_members. Typed JSON-LD objects come
    first, then OpenGraph, then meta tags and title; for each field the first object that has it."""
    typed = F.filter(json_ld, lambda x: F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")) != "")
    raw = F.try_element_at(F.filter(F.transform(typed, lambda x: F.get_json_object(x, "$.address")), lambda v: v.isNotNull()), F.lit(1))
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    is_object = F.coalesce(raw.startswith("{"), F.lit(False))
    address = F.struct(at("streetAddress").alias("street"), at("addressLocality").alias("city"), at("addressRegion").alias("state"), at("postalCode").alias("postal_code"), at("addressCountry").alias("country"), F.when(~is_object, raw).alias("raw"))
    person = F.filter(typed, lambda x: F.lower(F.get_json_object(x, "$['@type']")) == "person")
    names = F.flatten(F.transform(typed, lambda x: F.coalesce(F.from_json(F.get_json_object(x, "$.hasOfferCatalog.itemListElement[*].name"), "array<string>"), F.array(F.get_json_object(x, "$.hasOfferCatalog.itemListElement[*].name")))))
    present = lambda arr: F.array_distinct(F.array_compact(arr))
    return F.struct(
        F.coalesce(_first(typed, "$.name", 500), F.nullif(open_graph["site_name"], F.lit("")), meta["og:site_name"], F.nullif(title, F.lit(""))).alias("name"),
        F.coalesce(_first(typed, "$.description", 2000), F.nullif(open_graph["description"], F.lit("")), F.nullif(description, F.lit(""))).alias("description"),
        F.when(raw.isNotNull(), address).alias("address"),
        present(F.transform(typed, lambda x: F.nullif(F.get_json_object(x, "$.telephone"), F.lit("")))).alias("phone_numbers"),
        _first(typed, "$.openingHours").alias("opening_hours"),
        present(names).alias("services"),
        F.transform(person, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.jobTitle").alias("title"), F.get_json_object(x, "$.email").alias("email"))).alias("team_members"),
    )
