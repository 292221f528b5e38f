"""The query catalogue: one thin query for each operator. ``oracle`` has the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import emails as E
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..operators import enrichment as N
from ..operators import domains, extraction, scoring, store, validation
from ..operators.numbering import numbered, page_after
from ..sources import feeds, imports
from ..streaming import jobs as J
from ..streaming import state as S
from . import fixtures as D
from .export import export_companies, export_company, export_totals

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_pages(spark: SparkSession) -> DataFrame:
    return D.frame(spark, D.PAGES, "page_id long, domain string, url string, html string")


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table with each page's host as its company."""
    return table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("domain"), "url", "html")


#: Added to the ids of the pages table where fixture pages stand beside it.
BESIDE = 1_000_000


def both_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture pages and the whole table of pages."""
    return fixture_pages(spark).unionByName(whole_pages(spark, sf_dir).withColumn("page_id", F.col("page_id") + BESIDE))


def rich_pages(spark: SparkSession) -> DataFrame:
    return D.frame(spark, D.RICH_PAGES, "page_id long, domain string, url string, success boolean, html string")


def both_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whole_pages(spark, sf_dir).withColumn("page_id", F.col("page_id") + BESIDE).withColumn("success", F.lit(True))
    return rich_pages(spark).unionByName(whole)


def _page_query(fixture: Callable[[SparkSession], DataFrame], both: Callable[[SparkSession, str], DataFrame]):
    """Registers f(spark, pages) over the fixture pages, and as ``.._all`` over these and the whole table."""

    def register(f: Callable[[SparkSession, DataFrame], DataFrame]):
        _found[f.__name__] = lambda spark, sf_dir: f(spark, fixture(spark))
        _found[f"{f.__name__}_all"] = lambda spark, sf_dir: f(spark, both(spark, sf_dir))
        return f

    return register


def listed(c: Column) -> Column:
    """An array as text, null as empty."""
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return docs.select("source", "doc_id", F.posexplode(E.scan(F.col("text"))).alias("match_no", "raw")).withColumn("address", X.clean_address(F.col("raw")))


# -- addresses -----------------------------------------------------------------------------------------------


@_query
def email_scan(spark, sf_dir):
    docs = document_emails(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "match_no", "address")
    pages = table(spark, sf_dir, "pages").where(F.col("html").contains("@")).select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.posexplode(E.scan(F.col("html"))).alias("match_no", "raw"))
    return docs.unionByName(pages.select("origin", "id", "match_no", X.clean_address(F.col("raw")).alias("address")))


def _scan_quoted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", listed(E.scan_quoted(F.col("html"))).alias("found"))


@_query
def email_scan_quoted(spark, sf_dir):
    return _scan_quoted(fixture_pages(spark))


@_query
def email_scan_quoted_all(spark, sf_dir):
    return _scan_quoted(whole_pages(spark, sf_dir))


@_query
def email_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return docs.select("doc_id", listed(F.array_sort(E.scan_distinct(F.col("text")))).alias("addresses")).where("addresses <> ''")


@_query
def email_hash(spark, sf_dir):
    return document_emails(spark, sf_dir).select("address", X.stable_hash(F.col("address")).alias("address_hash")).distinct()


@_query
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_hash(F.col("text")).alias("content_hash"))


def _address_fixture(spark: SparkSession) -> DataFrame:
    return D.frame(spark, D.ADDRESSES, "address string")


_FLAGS = ["is_valid_syntax", "is_valid_domain", "mx_valid", "smtp_valid", "is_disposable", "is_role_based", "validation_score", "validation_status", "notes"]


@_query
def email_validate(spark, sf_dir):
    return validation.validate(document_emails(spark, sf_dir).select("doc_id", "match_no", "address")).select("doc_id", "match_no", "address", *_FLAGS)


@_query
def email_validate_facts(spark, sf_dir):
    mx = D.frame(spark, D.MX, "email_domain string, host string").select("email_domain", F.array("host").alias("mx_hosts"))
    return validation.validate(_address_fixture(spark), mx=mx, dns=D.frame(spark, D.DNS, "email_domain string, resolves boolean"), smtp=D.frame(spark, D.SMTP, "address string, smtp_valid boolean")).select("address", *_FLAGS)


@_query
def email_status_counts(spark, sf_dir):
    return validation.validate(document_emails(spark, sf_dir).select("address")).groupBy("validation_status").agg(F.count(F.lit(1)).alias("n"))


@_query
def email_parts(spark, sf_dir):
    a = X.normalise_address(F.col("address"))
    return _address_fixture(spark).where(F.col("address").contains("@")).select("address", E.local_part(a).alias("local"), E.domain_part(a).alias("domain"), E.valid_domain(E.domain_part(a)).alias("domain_ok"))


@_query
def disposable_semi(spark, sf_dir):
    known = D.frame(spark, C.DISPOSABLE_DOMAINS + C.PLACEHOLDER_DOMAINS, "domain string")
    df = _address_fixture(spark).withColumn("domain", E.domain_part(X.normalise_address(F.col("address"))))
    return df.join(F.broadcast(known), "domain", "left_semi").select("address")  # a fixed list


@_query
def role_semi(spark, sf_dir):
    known = D.frame(spark, C.ROLE_PREFIXES, "local string")
    df = _address_fixture(spark).withColumn("local", E.local_part(X.normalise_address(F.col("address"))))
    return df.join(F.broadcast(known), "local", "left_semi").select("address")  # a fixed list


@_query
def score_signals(spark, sf_dir):
    names = ["via_mailto", "on_contact_page", "mx_valid", "company_domain_match", "is_disposable", "is_role_based"]
    df = D.frame(spark, D.SIGNALS, "method string, " + ", ".join(f"{n} boolean" for n in names))
    signals = {n: F.col(n) for n in names} | {"via_comment": F.col("method") == "html_comment", "via_ocr": F.col("method") == "ocr"}
    score = scoring.confidence(F.col("method"), signals)
    return df.select("method", *names, score.alias("confidence"), scoring.tier(score).alias("tier"))


@_query
def email_first_occurrence(spark, sf_dir):
    finds = document_emails(spark, sf_dir).select("source", "doc_id", F.lit(1).alias("pass_no"), F.lit(1).alias("strategy_no"), "match_no", "address")
    return extraction.first_occurrence(finds, "source", "doc_id").select("source", "address", "doc_id", "match_no", "address_hash")


@_query
def email_pipeline(spark, sf_dir):
    """Scan, first occurrence by company, validation, score, and only then the threshold."""
    finds = document_emails(spark, sf_dir).select("source", "doc_id", F.lit(1).alias("pass_no"), F.lit(1).alias("strategy_no"), "match_no", "address", F.lit("html_regex").alias("method"))
    first = validation.validate(extraction.first_occurrence(finds, "source", "doc_id"))
    scored = scoring.score_finds(first, F.lit(""), F.col("source"))
    return scored.where(F.col("confidence") >= C.MIN_CONFIDENCE).select("source", "address", "address_hash", "doc_id", "confidence", "validation_status", "is_role_based")


@_query
def page_finds(spark, sf_dir):
    """Every find of every page with its pass, strategy and match."""
    pages = table(spark, sf_dir, "pages")
    df = extraction.explode_finds(pages, F.col("html"))
    return df.select("page_id", "pass_no", "strategy_no", "match_no", "address", "method", "hint")


@_page_query(fixture_pages, both_pages)
def fixture_finds(spark, pages):
    first = extraction.first_on_page(extraction.explode_finds(pages, F.col("html")), ["page_id"])
    return first.select("page_id", "pass_no", "address", "method", "hint")


def _company_emails(pages: DataFrame) -> DataFrame:
    """The stored addresses of each company: all strategies, all passes, first occurrence, validation, score, threshold."""
    finds = extraction.explode_finds(pages, F.col("html")).select("domain", "page_id", "url", "pass_no", "strategy_no", "match_no", "address", "method")
    first = validation.validate(extraction.first_occurrence(finds, "domain", "page_id"))
    company = F.regexp_replace(F.col("domain"), "^www[.]", "")
    return scoring.score_finds(first, F.col("url"), company).where(F.col("confidence") >= C.MIN_CONFIDENCE).select("domain", "address", "method", "confidence", "validation_status", "page_id")


@_query
def company_emails(spark, sf_dir):
    return _company_emails(fixture_pages(spark))


@_query
def company_emails_all(spark, sf_dir):
    return _company_emails(whole_pages(spark, sf_dir))


def _strategy(name: str, scan: Callable[[Column], Column]) -> None:
    def run(spark, pages):
        return pages.select("page_id", listed(scan(F.col("html"))).alias("found"))

    run.__name__ = name
    _page_query(fixture_pages, both_pages)(run)


for _name, _scan in (("script_emails", E.in_scripts), ("comment_emails", E.in_comments), ("base64_emails", E.in_base64), ("obfuscated_emails", E.obfuscated), ("cloudflare_emails", E.cloudflare), ("mailto_emails", E.mailto)):
    _strategy(_name, _scan)


@_query
def page_comment_emails(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(C.COMMENT), F.lit(1))).alias("comments"), listed(E.in_comments(F.col("html"))).alias("found"))


def _emails_per_page(pages: DataFrame) -> DataFrame:
    """How many addresses each pass counts on a page, before companies are looked at."""
    first = extraction.first_on_page(extraction.explode_finds(pages, F.col("html")), ["page_id"])
    counts = first.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("emails_found"))


@_query
def emails_per_page(spark, sf_dir):
    return _emails_per_page(fixture_pages(spark))


@_query
def emails_per_page_all(spark, sf_dir):
    return _emails_per_page(whole_pages(spark, sf_dir))


# -- URLs and domains ---------------------------------------------------------------------------------------


@_query
def url_validate(spark, sf_dir):
    u = F.col("url")
    return D.frame(spark, D.URLS, "url string").select("url", U.invalid_reason(u).alias("reason"), U.sanitised(u).alias("clean"))


@_query
def url_safe(spark, sf_dir):
    u = F.col("url")
    fixture = D.frame(spark, D.URLS, "url string")
    return fixture.unionByName(table(spark, sf_dir, "pages").select("url")).select("url", U.is_safe(u).alias("safe"), U.is_contact_page(u).alias("contact"), U.is_maps(u).alias("maps")).distinct()


@_query
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalised(F.col("url")).alias("normal"), U.base_url(F.col("url")).alias("base"), U.host(F.col("url")).alias("host"))


@_query
def domain_normalize(spark, sf_dir):
    raw = F.col("raw")
    return D.frame(spark, D.DOMAINS, "raw string").select("raw", U.normal_domain(raw).alias("domain"), U.clean_domain(raw).alias("cleaned"), U.form_domain(raw).alias("form"), U.domain_reason(raw).alias("reason"), U.maps_placeholder(raw).alias("placeholder"), U.is_maps_pending(U.clean_domain(raw)).alias("pending"))


@_query
def suffix_domains(spark, sf_dir):
    """Suffix and registered domain of every page's host and of hosts under rules of all kinds, by a table of rules."""
    hosts = D.frame(spark, [(h, 0) for h in D.SUFFIX_HOSTS], "host string, page_id long").unionByName(table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "page_id"))
    found = domains.registered_domains(hosts, "host", D.frame(spark, D.SUFFIX_RULES, "rule string"))
    return found.groupBy("host", "suffix", "registered").agg(F.count(F.lit(1)).alias("n"))


@_query
def registered_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.registered_domain(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))


# -- pages ------------------------------------------------------------------------------------------------------


@_query
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


def _page_meta(pages: DataFrame) -> DataFrame:
    m = F.map_entries(H.meta(F.col("html")))
    return pages.select("page_id", listed(F.array_sort(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("meta"), H.description(F.col("html")).alias("description"))


@_query
def page_meta(spark, sf_dir):
    return _page_meta(fixture_pages(spark))


@_query
def page_meta_all(spark, sf_dir):
    return _page_meta(whole_pages(spark, sf_dir))


@_query
def page_footer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.section_text(F.col("html"), "footer", 5000).alias("footer"), H.section_text(F.col("html"), "header", 2000).alias("header"))


@_query
def page_text_len(spark, sf_dir):
    text = F.left(H.visible_text(F.col("html")), F.lit(50000))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    contact = pages.groupBy("host").agg(F.max(U.is_contact_page(F.col("url"))).alias("has_contact"))
    footer = H.section_text(F.col("html"), "footer", 5000)
    found = N.issue_list(F.lit(True), F.col("url"), F.lit(None).cast("int"), F.lit(None).cast("double"), F.col("html"), footer, F.col("has_contact"), 2026)
    return pages.join(contact, "host").withColumn("issues", found)


@_query
def page_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("page_id", listed(F.col("issues.code")).alias("codes"))


@_query
def issue_summary(spark, sf_dir):
    return _issues(spark, sf_dir).select("page_id", N.issue_summary(F.col("issues.text")).alias("summary"))


@_query
def issue_counts(spark, sf_dir):
    return _issues(spark, sf_dir).select(F.explode("issues.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@_page_query(fixture_pages, both_pages)
def tech_detect(spark, pages):
    headers = D.frame(spark, D.HEADERS, "page_id long, headers map<string,string>")
    df = pages.join(headers, "page_id", "left").withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    return df.select("page_id", listed(F.transform(H.technologies(F.col("html"), F.col("headers")), lambda t: F.concat_ws("/", t["name"], t["category"], t["detection"]))).alias("technologies"))


@_query
def tech_pages(spark, sf_dir):
    """Technologies of all pages, merged by site, the first page of each name."""
    df = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), F.explode(H.technologies(F.col("html")).getField("name")).alias("name"))
    return df.groupBy("host", "name").agg(F.min("page_id").alias("first_page"))


@_page_query(fixture_pages, both_pages)
def social_links(spark, pages):
    return pages.select("page_id", F.explode(H.social_links(F.col("html"))).alias("platform", "link"))


@_page_query(fixture_pages, both_pages)
def social_merged(spark, pages):
    rows = pages.select("domain", "page_id", F.explode(H.social_links(F.col("html"))).alias("platform", "link"))
    merged = N.first_map(rows, ["domain"], F.col("page_id"), "platform", "link", "links")
    return merged.select("domain", F.explode("links").alias("platform", "link"))


@_query
def phone_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{4}"))
    return docs.select("doc_id", listed(H.phones(F.col("text"))).alias("phones")).where("phones <> ''")


@_query
def phone_union(spark, sf_dir):
    """Numbers of each source in the order in which they were first seen."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{4}"))
    rows = docs.select("source", "doc_id", F.posexplode(H.phones(F.col("text"))).alias("at", "phone"))
    return N.union_in_order(rows, ["source"], ["doc_id", "at"], "phone", "phones").select("source", listed(F.col("phones")).alias("phones"))


@_query
def business_summary(spark, sf_dir):
    df = D.frame(spark, D.SUMMARIES, "id long, description string, services string, industry string, category string")
    return df.select("id", N.business_summary(F.col("description"), F.split("services", r"\|", -1), F.col("industry"), F.col("category"), "No business description found on site.").alias("summary"))


@_page_query(fixture_pages, both_pages)
def home_pages(spark, pages):
    return N.home_page(pages, "domain", F.col("url"), F.concat(U.base_url(F.col("url")), F.lit("/")), F.col("page_id")).select("domain", "page_id")


@_query
def escalation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.escalate(F.lit(True), F.lit(200), F.col("html")).alias("escalate")).where("escalate")


@_query
def pages_per_host(spark, sf_dir):
    df = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    return df.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"), F.sum(F.length("html")).alias("chars"))


# -- sitemaps, feeds, imports --------------------------------------------------------------------------------


@_query
def sitemap_urls(spark, sf_dir):
    df = D.frame(spark, D.SITEMAPS, "base_url string, priority long, xml string")
    return df.select("base_url", "priority", listed(feeds.sitemap_urls(F.col("xml"))).alias("urls"))


@_query
def sitemap_best(spark, sf_dir):
    df = D.frame(spark, D.SITEMAPS, "base_url string, priority long, xml string")
    return feeds.best_sitemap(df, "base_url", "priority", F.col("xml")).select("base_url", listed(F.col("pages")).alias("pages"))


@_query
def robots_sitemap(spark, sf_dir):
    return D.frame(spark, D.ROBOTS, "base_url string, txt string").select("base_url", feeds.robots_sitemap(F.col("txt")).alias("sitemap"))


@_query
def crawl_plan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.base_url(F.col("url")).alias("base"), "url")
    return N.site_pages(pages, "base", "url").select("base", listed(N.crawl_plan(F.col("base"), F.col("urls"))).alias("plan"))


def _import_rows(spark: SparkSession) -> DataFrame:
    rows = [(n, w, i + 2) for i, (n, w) in enumerate(D.COMPANY_CSV)]
    return D.frame(spark, rows, "company_name string, Website string, source_row long")


@_query
def import_clean(spark, sf_dir):
    return imports.clean_import(_import_rows(spark))


@_query
def import_summary(spark, sf_dir):
    df = imports.import_summary(imports.clean_import(_import_rows(spark)))
    return df.withColumn("errors", listed(F.col("errors")))


@_query
def import_anti(spark, sf_dir):
    return imports.new_companies(imports.clean_import(_import_rows(spark)), D.frame(spark, D.STORED, "domain string")).select("source_row", "domain", "website")


@_query
def import_customers(spark, sf_dir):
    """Insert-if-absent at size: customers with even keys are stored, all are offered, the first of each name group is new."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 1000).alias("group"), "c_nationkey")
    return store.insert_new(c.where("c_custkey % 2 = 0 and c_nationkey < 12"), c, ["group"], ["c_custkey"])


@_query
def maps_resolve(spark, sf_dir):
    df = D.frame(spark, D.MAPS, "id long, url string, resolved string")
    pending = df.select("id", U.maps_placeholder(F.col("url")).alias("domain"), F.col("url").alias("website"))
    return imports.resolve_maps(pending, df.select(F.col("url").alias("maps_url"), F.col("resolved").alias("resolved_url")), D.frame(spark, D.STORED, "domain string"))


# -- the store: orders stand for companies, customers for their owners --------------------------------------------


@_query
def status_counts(spark, sf_dir):
    return store.count_by(table(spark, sf_dir, "orders"), "o_orderstatus").withColumnRenamed("o_orderstatus", "status")


@_query
def status_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    return store.page_of(o, [F.col("o_orderdate"), F.col("o_orderkey")], 100, 200)


@_query
def keyset_page(spark, sf_dir):
    """The page behind a key, however deep it lies."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey", "o_custkey")
    return page_after(o, ["at", "o_orderkey"], [datetime(1996, 7, 1, tzinfo=UTC), 100], 100).select(F.unix_seconds("at").alias("at"), "o_orderkey", "o_custkey")


@_query
def customer_places(spark, sf_dir):
    """Places in an order of text whose first column has five values, so that the later ones decide."""
    return numbered(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey"), ["c_mktsegment", "c_name", "c_custkey"])


@_query
def topk_per_company(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return store.top_per(o, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@_query
def topk_global(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 1000").select("o_orderkey", "o_totalprice")
    return store.page_of(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 500)


@_query
def count_per_company(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@_query
def stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return store.count_by(o, "o_orderstatus").crossJoin(o.agg(F.count_if(F.col("o_totalprice") > 100000).alias("valid")))  # one row


@_query
def export_nested(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderstatus")
    nested = store.nest(c, o.where("o_orderstatus <> 'P'"), "c_custkey", ["o_orderkey", "o_orderstatus"], "orders", [(-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")])
    return nested.select("c_custkey", "c_name", F.size("orders").alias("n"), listed(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"]))).alias("orders"))


@_query
def export_totals_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return export_totals(store.nest(c, o, "c_custkey", ["o_orderkey"], "emails", [F.col("o_orderkey").alias("k")]))


@_query
def status_split(spark, sf_dir):
    """Companies with and without addresses."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(o, "c_custkey", "left").groupBy(F.when(F.col("n") > 0, "leads").otherwise("no_email").alias("kind")).agg(F.count(F.lit(1)).alias("companies"))


@_query
def engines_used(spark, sf_dir):
    """Distinct values in the order in which they were first seen, for each key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return N.union_in_order(li, ["l_orderkey"], ["l_linenumber"], "l_returnflag", "flags").select("l_orderkey", listed(F.col("flags")).alias("flags"))


@_query
def batch_ids(spark, sf_dir):
    return store.batch_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@_query
def keyed_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    updates = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("completed").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "1-URGENT").alias("o_orderpriority"))
    return store.keyed_update(o, updates, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@_query
def increment_retry(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("retry_count"))
    return store.increment(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", "retry_count")


@_query
def retry_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("retry_count"))
    again, dead = J.split_retries(o)
    return again.withColumn("dead_letter_source", F.lit(None).cast("string")).unionByName(dead)


@_query
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return store.cascade_delete(li, gone, "l_orderkey", "o_orderkey")


def _job_emails(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Jobs that list ids, each id looked up, unknown ones skipped."""
    jobs = orders.select("o_orderkey", F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 100000)).alias("c_custkey"))
    return jobs.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_custkey", "c_name")


@_query
def job_emails(spark, sf_dir):
    return _job_emails(spark, sf_dir, table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0"))


@_query
def job_emails_all(spark, sf_dir):
    return _job_emails(spark, sf_dir, table(spark, sf_dir, "orders"))


@_query
def job_round_trip(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("company_id"), F.col("o_orderstatus").alias("domain"))
    return J.parse_jobs(J.job_json(jobs)).select("job_id", "company_id", "domain", "priority", "retry_count")


@_query
def truthy_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("New "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", X.truthy(new, F.col("c_name")).alias("name"))


@_query
def queue_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), seconds.alias("s")).select("event_type", "n", store.jobs_per_minute(F.col("n"), F.col("s")).alias("per_minute"))


@_query
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", X.backoff_seconds(F.col("r_regionkey") * 2).alias("seconds"))


@_query
def recent_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return J.suppress_recent(e, "user_id", "s").select("event_id", "user_id", "s")


@_query
def token_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return J.token_bucket(e, "event_type", "s", 5.0, "event_id").select("event_id", "event_type", F.round("wait", 6).alias("wait"))


@_query
def gated_events(spark, sf_dir):
    """What becomes of jobs that come as a stream: purchases end a job with success, errors without, all other events are jobs."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("job")
    at = [F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"), kind, F.col("ts").cast("timestamp")]
    out = S.gate_files(spark, table(spark, sf_dir, "events"), f"{sf_dir}/events*.parquet", at, lock=6 * 3600)
    return out.where("outcome <> 'expired'").groupBy("key", "job_id", "at_ms", "outcome").agg(F.count(F.lit(1)).alias("n"))


# -- pages with structured data, references and sections by class; runs and queues ----------------------------------


@_page_query(rich_pages, both_rich)
def rich_finds(spark, pages):
    """All strategies, that over JSON-LD included, with the first of each pass of a page."""
    from ..operators.parsing import parse_html

    pages = pages.withColumn("parsed", parse_html(F.col("html")))
    finds = extraction.explode_finds(pages, F.col("html"), F.col("parsed.schema_addresses"))
    return extraction.first_on_page(finds, ["page_id"]).select("page_id", "pass_no", "address", "method", "hint")


@_page_query(rich_pages, both_rich)
def schema_emails(spark, pages):
    from ..operators.parsing import parse_html

    return pages.select("page_id", listed(F.array_sort(F.array_distinct(parse_html(F.col("html"))["schema_addresses"]))).alias("found"))


@_page_query(rich_pages, both_rich)
def rich_sections(spark, pages):
    html = F.col("html")
    footer = H.section_text(html, "footer", 5000)
    return pages.select("page_id", H.title(html).alias("title"), footer.alias("footer"), H.section_text(html, "header", 2000).alias("header"), F.coalesce(H.copyright_year(footer).cast("string"), F.lit("")).alias("year"), H.description(html).alias("description"))


@_query
def open_graph(spark, sf_dir):
    rich = rich_pages(spark).select("page_id", "html")
    both = rich.unionByName(table(spark, sf_dir, "pages").select("page_id", "html"))
    return both.select("page_id", F.explode(H.open_graph(F.col("html"))).alias("name", "content"))


@_page_query(rich_pages, both_rich)
def company_metadata(spark, pages):
    """Name and description by the first usable page of each company."""
    from ..operators.parsing import company_facts, parse_html

    html = F.col("html")
    pages = pages.withColumn("parsed", parse_html(html))
    facts = company_facts(F.col("parsed.json_ld"), H.open_graph(html), H.meta(html), H.title(html), H.description(html))
    found = N.first_page_facts(pages, "domain", F.col("page_id"), facts)
    return found.select("domain", F.col("facts.name").alias("name"), F.col("facts.description").alias("description"), listed(F.col("facts.phone_numbers")).alias("phones"))


@_page_query(rich_pages, both_rich)
def company_phones(spark, pages):
    """Stated numbers of the first usable page, then those in the texts of all usable pages in order."""
    from ..operators.parsing import company_facts, parse_html

    html = F.col("html")
    pages = N.usable(pages).withColumn("parsed", parse_html(html))
    facts = company_facts(F.col("parsed.json_ld"), H.open_graph(html), H.meta(html), H.title(html), H.description(html))
    stated = N.first_page_facts(pages, "domain", F.col("page_id"), facts).select("domain", F.col("facts.phone_numbers").alias("stated"))
    rows = pages.select("domain", "page_id", F.posexplode(H.phones(H.visible_text(html))).alias("at", "phone"))
    found = N.union_in_order(rows, ["domain"], ["page_id", "at"], "phone", "found")
    return stated.join(found, "domain", "left").select("domain", listed(N.phones_of_company(F.col("stated"), F.col("found"))).alias("phones"))


@_query
def site_technologies(spark, sf_dir):
    """As tech_pages, with the fixture pages, whose sites use some."""
    pages = fixture_pages(spark).select("page_id", "url", "html").unionByName(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = pages.select("page_id", U.host(F.col("url")).alias("host"), F.explode(H.technologies(F.col("html"))).alias("t"))
    best = found.groupBy("host", F.col("t.name").alias("name")).agg(F.min(F.struct("page_id", "t.category", "t.detection")).alias("first"))
    return best.select("host", "name", "first.page_id", "first.category", "first.detection")


@_query
def page_profiles(spark, sf_dir):
    """Profile links of all pages and of the fixture's, merged by host, the first of each platform."""
    pages = fixture_pages(spark).select("page_id", "url", "html").unionByName(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = pages.select(U.host(F.col("url")).alias("host"), "page_id", F.explode(H.social_links(F.col("html"))).alias("platform", "link"))
    return N.first_map(rows, ["host"], F.col("page_id"), "platform", "link", "links").select("host", F.explode("links").alias("platform", "link"))


@_query
def escalated_pages(spark, sf_dir):
    """Pages that need a browser: those that gave no answer, or hardly any content."""
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5 != 0).alias("success"), F.when(F.col("page_id") % 7 != 0, 200).alias("status"), F.when(F.col("page_id") % 9 == 0, F.left("html", F.lit(300))).otherwise(F.col("html")).alias("html"))
    return pages.select("page_id", U.escalate(F.col("success"), F.col("status"), F.col("html")).alias("escalate")).where("escalate")


@_query
def usable_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3 != 0).alias("success"), F.when(F.col("page_id") % 5 != 0, F.col("html")).alias("html"))
    return N.usable(pages.unionByName(rich_pages(spark).select("page_id", "success", "html"))).select("page_id", F.length("html").alias("chars"))


@_query
def feed_heads(spark, sf_dir):
    return D.frame(spark, D.FEEDS, "id long, xml string").select("id", feeds.feed(F.col("xml")).alias("f")).select("id", "f.title", "f.description", "f.link")


@_query
def feed_links(spark, sf_dir):
    both = rich_pages(spark).select("page_id", "html").unionByName(table(spark, sf_dir, "pages").select("page_id", "html"))
    return both.select("page_id", feeds.feed_url(F.col("html")).alias("feed")).where("feed is not null")


@_query
def crawled_issues(spark, sf_dir):
    """Issues of pages that were fetched in all ways: not at all, with an error, slowly."""
    pages = table(spark, sf_dir, "pages").withColumn("success", F.col("page_id") % 11 != 0).withColumn("status", F.when(F.col("page_id") % 7 == 0, 503).otherwise(200)).withColumn("ms", (F.col("page_id") % 40 * 260).cast("double"))
    found = N.issue_list(F.col("success"), F.col("url"), F.col("status"), F.col("ms"), F.col("html"), H.section_text(F.col("html"), "footer", 5000), F.lit(True), 2026)
    return pages.select("page_id", F.explode(found).alias("issue")).where("issue.code in ('unreachable', 'bad_status', 'slow_load', 'outdated_copyright')").select("page_id", "issue.code", "issue.text")


@_query
def export_filtered(spark, sf_dir):
    """Companies with their addresses of enough confidence that are no duplicates, by the export operator."""
    return _exported(spark, sf_dir, lambda c, e: export_companies(c, e, 60))


@_query
def export_one(spark, sf_dir):
    return _exported(spark, sf_dir, lambda c, e: export_company(c, e, "7"))


def _exported(spark: SparkSession, sf_dir: str, export) -> DataFrame:
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    key = F.col("o_orderkey")
    emails = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_id"), key.cast("string").alias("address"), (key % 101).cast("int").alias("confidence"), (key % 4 == 0).alias("is_duplicate"), F.lit("").alias("source"), F.lit("mailto").alias("method"),
        F.lit("").alias("page"), F.col("o_orderstatus").alias("validation_status"), F.lit(True).alias("mx_valid"), F.lit(False).alias("is_disposable"), F.lit(False).alias("is_role_based"), F.lit(None).cast("timestamp").alias("discovered_at"),
    )
    return export(companies, emails).select("id", "name", listed(F.transform("emails", lambda e: F.concat_ws(":", e["confidence"].cast("string"), e["address"], e["validation_status"]))).alias("emails"))


@_query
def insert_two_keys(spark, sf_dir):
    """Addresses that a company does not have yet: a key of two columns, the first of equal ones."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return store.insert_new(li.where("l_orderkey % 3 = 0"), li, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])


@_query
def engines_of_run(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("engines"))  # three names at most
    return N.engines_of_run(li, "engines").select(listed(F.col("engines")).alias("engines"))


@_query
def company_lookup(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@_query
def iso_times(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", X.iso_timestamp(at).alias("iso"), X.file_stamp(at).alias("stamp"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), "o_orderdate", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"), "o_orderstatus")


@_query
def claimed_jobs(spark, sf_dir):
    """One job of a domain at a time; the others go back."""
    mine, back = J.claim(_jobs(spark, sf_dir), "domain", ["day", "o_orderkey"])
    return mine.select("domain", "o_orderkey", F.lit("claimed").alias("outcome")).unionByName(back.select("domain", "o_orderkey", F.lit("queued").alias("outcome")))


@_query
def not_recent_jobs(spark, sf_dir):
    """Jobs whose domain was not done within 400 days; only finished ones count."""
    jobs = _jobs(spark, sf_dir)
    return J.not_recent(jobs.where("o_orderstatus <> 'F'"), jobs.where("o_orderstatus = 'F'"), "domain", "day", "day", 400).select("domain", "o_orderkey")


@_query
def run_progress(spark, sf_dir):
    status = F.expr("case o_orderstatus when 'F' then 'done' when 'O' then 'queued' when 'P' then 'failed' end")
    return J.progress(table(spark, sf_dir, "orders").select(status.alias("status")), "status")


@_query
def parsed_pages(spark, sf_dir):
    """Links of all pages, resolved against each page's URL."""
    from ..operators.parsing import with_parsed

    df = with_parsed(table(spark, sf_dir, "pages"))
    return df.select("page_id", F.size("links").alias("links"), F.size("pdf_links").alias("pdfs"), F.size("image_links").alias("images"), F.md5(listed(F.col("links"))).alias("digest"))
