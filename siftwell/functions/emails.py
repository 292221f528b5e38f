"""Addresses in text and HTML: scanning, decoding, syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import clean_address
from .tree import parts


def _found(c: Column, pattern: str) -> Column:
    """All matches of a pattern that needs an at sign; texts without one, which are most, are not searched."""
    none = F.when(c.isNotNull(), F.array().cast("array<string>"))
    return F.when(c.contains("@"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(none)


def scan(c: Column) -> Column:
    return _found(c, C.EMAIL)


def scan_quoted(c: Column) -> Column:
    """As ``scan``, with local parts in quotes."""
    return _found(c, C.EMAIL_OR_QUOTED)


def scan_distinct(c: Column) -> Column:
    return F.array_distinct(scan_quoted(c))


def scan_outside_urls(c: Column) -> Column:
    """Addresses that do not follow a slash (those are the credentials of a URL)."""
    found = _found(c, f"(?i)/?(?:{C.EMAIL.removeprefix('(?i)')})")
    return F.filter(found, lambda x: ~x.startswith("/"))


def _each(blocks: Column, one) -> Column:
    return F.flatten(F.transform(blocks, one))


def in_scripts(html: Column) -> Column:
    return _each(F.regexp_extract_all(html, F.lit(C.SCRIPT), F.lit(1)), scan_outside_urls)


def in_comments(html: Column) -> Column:
    return _each(F.regexp_extract_all(html, F.lit(C.COMMENT), F.lit(1)), scan)


def in_base64(html: Column) -> Column:
    """Bad padding gives nothing; bytes that are no UTF-8 are left out."""
    decoded = F.transform(F.regexp_extract_all(html, F.lit(C.BASE64), F.lit(1)), lambda x: F.replace(F.make_valid_utf8(F.try_to_binary(x, F.lit("base64")).cast("string")), F.lit("\ufffd"), F.lit("")))
    return _each(F.filter(decoded, lambda x: x.isNotNull()), scan_outside_urls)


def obfuscated(html: Column) -> Column:
    """``name (at) host (dot) tld``; the dot must be spelt out, and pages without one are not searched."""
    parts = [F.regexp_extract_all(html, F.lit(C.OBFUSCATED), F.lit(i)) for i in (1, 2, 3)]
    rebuilt = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), lambda x: F.concat(x["a"], F.lit("@"), x["b"], F.lit("."), x["c"]))
    spelt = html.rlike(r"(?i)[\[({]dot[\])}]|\bdot\b")
    return F.when(spelt, _each(rebuilt, scan)).otherwise(F.when(html.isNotNull(), F.array().cast("array<string>")))


def cloudflare_decode(code: Column) -> Column:
    """Hexadecimal bytes, all XORed with the first; null unless it looks like an address. An odd number of digits is none."""
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    n = F.floor(F.length(code) / 2).cast("int")
    chars = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(0)))))
    text = F.lower(F.array_join(chars, ""))
    good = (F.length(code) % 2 == 0) & (n >= 2)
    text = F.when(good, text)
    return F.when(text.contains("@") & F.substring_index(text, "@", -1).contains("."), text)


def cloudflare(html: Column) -> Column:
    codes = F.concat(F.regexp_extract_all(html, F.lit(C.CLOUDFLARE), F.lit(1)), F.regexp_extract_all(html, F.lit(C.CLOUDFLARE_LINK), F.lit(1)))
    return F.filter(F.transform(codes, cloudflare_decode), lambda x: x.isNotNull())


def mailto(html: Column) -> Column:
    """Targets of mailto links up to ``?``, character references decoded, not URL-decoded and not split; of the parsed page."""
    return parts(html)["mailto"]


def local_part(address: Column) -> Column:
    return F.left(address, F.length(address) - F.length(domain_part(address)) - 1)


def domain_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def valid_syntax(address: Column) -> Column:
    return F.coalesce((F.length(address) > 0) & (F.length(address) <= 320) & (F.length(local_part(address)) <= 64) & address.rlike(C.EMAIL_SYNTAX), F.lit(False))


def valid_domain(domain: Column) -> Column:
    labels = F.split(domain, r"\.", -1)
    each = F.forall(labels, lambda x: x.rlike(r"^[a-zA-Z0-9\-]{1,63}$") & ~x.startswith("-") & ~x.endswith("-"))
    return F.coalesce((F.length(domain) > 0) & (F.length(domain) <= 253) & domain.contains(".") & each & (F.length(F.element_at(labels, -1)) >= 2), F.lit(False))


def is_disposable(domain: Column) -> Column:
    return domain.isin(C.DISPOSABLE_DOMAINS + C.PLACEHOLDER_DOMAINS)


def is_role(local: Column) -> Column:
    return F.lower(local).isin(C.ROLE_PREFIXES)


def cleaned(found: Column) -> Column:
    return F.transform(found, clean_address)
