"""URLs and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import strip


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host in lower case, without user and port; an IPv6 host without its brackets."""
    name = F.lower(F.substring_index(netloc(url), "@", -1))
    return F.when(name.startswith("["), F.regexp_extract(name, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(name, ":", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _starts(name: Column, prefixes: list[str]) -> Column:
    return name.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def is_safe(url: Column) -> Column:
    name = host(url)
    return F.coalesce(scheme(url).isin("http", "https") & (name != "") & ~name.isin(C.SAFE_BLOCKED_HOSTS) & ~_starts(name, C.SAFE_BLOCKED_PREFIXES), F.lit(False))


def invalid_reason(raw: Column) -> Column:
    """Why a URL is refused, by the first rule that fails; null if it is fine."""
    url = strip(raw)
    name, where = host(url), F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    return (
        F.when(raw.isNull() | (raw == ""), "Empty or non-string URL")
        .when(F.length(url) > 2048, "URL too long")
        .when(url.contains("\0"), r"Blocked pattern detected: \x00")
        .when(F.lower(url).contains("<script"), "Blocked pattern detected: <script")
        .when(where.contains("../"), r"Blocked pattern detected: \.\./")
        .when(where.rlike("//[^/]"), "Blocked pattern detected: //[^/]")
        .when(~scheme(url).isin("http", "https"), F.concat(F.lit("Disallowed scheme: '"), scheme(url), F.lit("'")))
        .when(name == "", "Missing hostname")
        .when(name.isin(C.URL_BLOCKED_HOSTS), F.concat(F.lit("Blocked host: "), name))
        .when(_starts(name, C.URL_PRIVATE_PREFIXES), F.concat(F.lit("Private IP range blocked: "), name))
        .when(~name.contains(".") & ~name.startswith("["), F.concat(F.lit("Invalid hostname: "), name))
    )


def sanitised(raw: Column) -> Column:
    """Without its fragment; null if invalid."""
    return F.when(invalid_reason(raw).isNull(), F.substring_index(strip(raw), "#", 1))


def normalised(raw: Column) -> Column:
    """Scheme added if there is none, scheme and host in lower case, no slash at the end of the path, no fragment; null if empty."""
    url = strip(raw)
    url = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    trail = F.regexp_replace(path(url), "/+$", "")
    trail = F.when(trail == "", "/").otherwise(trail)
    rest = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.when(strip(raw) != "", F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), trail, rest))


def base_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def is_contact_page(url: Column) -> Column:
    return F.lower(url).rlike(C.CONTACT_PAGE)


def _bare(raw: Column) -> Column:
    name = F.lower(strip(raw))
    for prefix in ("https://", "http://", "www."):  # once each, in this order
        name = F.regexp_replace(name, "^" + prefix.replace(".", r"\."), "")
    return name


def clean_domain(raw: Column) -> Column:
    return F.regexp_extract(_bare(raw), "^[^/?#]*", 0)


def form_domain(raw: Column) -> Column:
    """Domain as an entry form takes it: prefixes off, slashes at the end off."""
    return F.rtrim(_bare(raw), F.lit("/"))


def domain_reason(raw: Column) -> Column:
    """Why a domain is refused, by the first rule that fails; null if it is fine."""
    d = F.lower(strip(raw))
    return (
        F.when(raw.isNull() | (raw == ""), "Empty domain")
        .when(F.length(d) > 253, "Domain too long")
        .when(d.isin(C.BLOCKED_DOMAINS), F.concat(F.lit("Blocked placeholder domain: "), d))
        .when(~d.rlike(C.DOMAIN_SYNTAX), F.concat(F.lit("Invalid domain format: "), d))
    )


def normal_domain(raw: Column) -> Column:
    """The bare domain of whatever was typed; null if invalid (a port makes it so)."""
    d = F.rtrim(clean_domain(raw), F.lit("."))
    return F.when(domain_reason(d).isNull(), d)


def is_maps(url: Column) -> Column:
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    name, where = F.lower(netloc(full)), F.lower(path(full))
    return F.coalesce((name.contains("google.") & where.contains("/maps")) | name.isin(C.MAPS_HOSTS), F.lit(False))


def maps_placeholder(url: Column) -> Column:
    return F.concat(F.lit("maps-"), F.substring(F.sha1(url), 1, 16), F.lit(".pending"))


def is_maps_pending(domain: Column) -> Column:
    return F.coalesce(domain.rlike(C.MAPS_PENDING), F.lit(False))


def registered_domain(url: Column, suffixes: list[str] | None = None) -> Column:
    """The label before the longest known public suffix, with it; null without one. The built-in list is small: pass a full one."""
    known = suffixes or ["com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "eu", "uk", "co.uk", "org.uk", "com.br", "com.au"]
    labels = F.split(F.when(url.contains("://"), host(url)).otherwise(clean_domain(url)), r"\.")
    take = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    out = F.lit(None).cast("string")
    for k in range(1, max(s.count(".") + 1 for s in known) + 1):
        size = [s for s in known if s.count(".") + 1 == k]
        out = F.when((F.size(labels) > k) & F.when(F.size(labels) > k, take(k)).isin(size), take(k + 1)).otherwise(out)
    return out


def escalate(success: Column, status: Column, html: Column) -> Column:
    """Whether a page without addresses is to be rendered in a browser."""
    return status.isNull() | (success & (F.length(F.coalesce(html, F.lit(""))) < 500))
