"""Golden values of scores, stages, text rules and parsing."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import constants as C
from siftwell.functions import emails as E
from siftwell.functions import html as H
from siftwell.functions import text as X
from siftwell.functions import urls as U
from siftwell.operators import enrichment as N
from siftwell.operators import extraction, parsing, scoring, store, validation
from siftwell.plans.export import export_companies, export_company, export_totals
from siftwell.sources import feeds, imports
from siftwell.sources import store as tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "method, signals, score",
    [
        ("mailto", ["via_mailto", "mx_valid", "company_domain_match"], 100),
        ("html_regex", ["is_disposable"], 10),
        ("footer", ["mx_valid", "is_role_based"], 65),
        ("cloudflare_decode", [], 70),
        ("html_comment", ["via_comment"], 40),
        ("ocr", ["via_ocr"], 25),
        ("ocr", ["via_ocr", "is_disposable", "is_malformed"], 0),
    ],
)
def test_confidence(spark, method, signals, score):
    assert one(spark, scoring.confidence(F.col("m"), {s: F.lit(True) for s in signals}), m=method) == score


def test_validation_table(spark):
    mx = spark.createDataFrame([("good.io", ["mx.good.io"])], "email_domain string, mx_hosts array<string>")
    addresses = spark.createDataFrame([("bob@good.io",), ("info@good.io",), ("bob@none.io",), ("info@none.io",), ("bob@mailinator.com",)], "address string")
    checked = {r.address: (r.validation_score, r.validation_status) for r in validation.validate(addresses, mx=mx).collect()}
    assert checked["bob@good.io"] == (85, "valid") and checked["info@good.io"] == (70, "valid")
    assert checked["bob@none.io"] == (50, "uncertain") and checked["info@none.io"] == (35, "invalid")
    unchecked = {r.address: (r.validation_score, r.validation_status) for r in validation.validate(addresses).collect()}
    assert unchecked["bob@none.io"] == (70, "valid") and unchecked["info@good.io"] == (55, "uncertain")
    assert unchecked["bob@mailinator.com"] == (20, "invalid")


def test_strip_takes_all_white_space(spark):
    assert one(spark, X.strip(F.col("s")), s="\t  a b \n ") == "a b"
    assert one(spark, X.sanitise(F.col("s")), s="\0 " + "x" * 600) == "x" * 500


def test_cloudflare(spark):
    plain = "test@example.com"
    code = "54" + "".join(f"{ord(c) ^ 0x54:02x}" for c in plain)
    assert one(spark, E.cloudflare_decode(F.col("c")), c=code) == plain
    assert one(spark, E.cloudflare_decode(F.col("c")), c="54313") is None
    assert one(spark, E.cloudflare_decode(F.col("c")), c="54") is None


def test_credentials_of_a_url_are_no_address(spark):
    html = '<script>a("https://key1@o1.ingest.dev/5"); b("me@site.io")</script>'
    assert one(spark, E.in_scripts(F.col("h")), h=html) == ["me@site.io"]


def test_quick_scan_accepts_quoted_local_parts(spark):
    assert one(spark, E.scan_quoted(F.col("h")), h='x "ab"@q.io y') == ['"ab"@q.io']


def test_weak_first_find_hides_a_stronger_one(spark):
    df = spark.createDataFrame([("c", 1, 2, 7, 0, "a@b.io", "html_comment"), ("c", 2, 1, 1, 0, "a@b.io", "mailto")], "company string, page int, pass_no int, strategy_no int, match_no int, address string, method string")
    found = extraction.first_occurrence(df, "company", "page").collect()
    assert len(found) == 1 and found[0].method == "html_comment" and len(found[0].address_hash) == 64


def test_issue_summary_stops_at_the_first_that_does_not_fit(spark):
    texts = ["Missing page title", "Missing meta description", "Not mobile-friendly (no viewport meta tag)", "No Schema.org/JSON-LD structured data"]
    got = spark.range(1).select(N.issue_summary(F.array(*map(F.lit, texts)))).first()[0]
    assert got == "Missing page title; Missing meta description; Not mobile-friendly (no viewport meta tag)"
    assert spark.range(1).select(N.issue_summary(F.array().cast("array<string>"))).first()[0] == C.NO_ISSUES


def test_unreachable_is_the_only_issue(spark):
    found = N.issue_list(F.lit(False), F.lit("http://x.io"), F.lit(500), F.lit(9000.0), F.lit(""), F.lit(""), F.lit(False), 2026)
    assert [r["code"] for r in spark.range(1).select(found).first()[0]] == ["unreachable"]
    slow = N.issue_list(F.lit(True), F.lit("https://x.io"), F.lit(404), F.lit(3260.0), F.lit("<title>t</title>"), F.lit("© 2020"), F.lit(True), 2026)
    texts = [r["text"] for r in spark.range(1).select(slow).first()[0]]
    assert texts[:2] == ["Homepage returned HTTP 404", "Slow load (3.3s)"] and "Outdated copyright year (2020)" in texts


def test_domains(spark):
    assert one(spark, U.normal_domain(F.col("d")), d=" https://www.Acme.com/x?y ") == "acme.com"
    assert one(spark, U.normal_domain(F.col("d")), d="http://acme.com:80") is None
    assert one(spark, U.registered_domain(F.col("d")), d="https://a.b.acme.co.uk/x") == "acme.co.uk"


def test_page_reader():
    html = """<a href="mailto:x@y.io">m</a><a href="/p.pdf">p</a><img src="i.png"><script type="application/ld+json">
    {"@type": "Org", "contactPoint": {"email": "not@entered.io"}, "department": [{"email": "dep@org.io"}], "Email": ["a@org.io", {"email": "b@org.io"}]}</script>
    <script type="application/ld+json">{bad</script><div itemtype="T"><span itemprop="name"> N </span><meta itemprop="u" content="v"></div>"""
    page = parsing.read_page(html)
    assert page["hrefs"] == ["mailto:x@y.io", "/p.pdf"] and page["images"] == ["i.png"]
    assert page["schema_addresses"][:3] == ["dep@org.io", "a@org.io", "b@org.io"] and "not@entered.io" not in page["schema_addresses"]
    assert page["microdata"] == [{"type": "T", "properties": {"u": "v", "name": "N"}}]
    assert parsing.read_page(None)["hrefs"] == [] and parsing.read_page("  ")["json_ld"] == []


def test_links_are_resolved_and_safe(spark):
    pages = spark.createDataFrame([("https://a.io/x/", '<a href="../b">b</a><a href="http://localhost/">l</a><a href="F.PDF">f</a><a href="mailto:q@a.io">m</a>')], "url string, html string")
    r = parsing.with_parsed(pages).first()
    assert r.links == ["https://a.io/b"] and r.pdf_links == ["https://a.io/x/F.PDF"]


def test_company_facts(spark):
    ld = '{"@type":"LocalBusiness","name":"Acme","telephone":"+1 555","address":{"streetAddress":"1 Road","addressRegion":"TX"},"hasOfferCatalog":{"itemListElement":[{"name":"A"},{"name":"B"}]}}'
    person = '{"@type":"Person","name":"Ann","jobTitle":"Boss"}'
    empty = F.create_map().cast("map<string,string>")
    got = spark.range(1).select(parsing.company_facts(F.array(F.lit(ld), F.lit(person)), empty, empty, F.lit("T"), F.lit("D")).alias("f")).first()["f"]
    assert got["name"] == "Acme" and got["description"] == "D" and got["address"]["state"] == "TX" and got["services"] == ["A", "B"]
    assert got["phone_numbers"] == ["+1 555"] and got["team_members"][0]["title"] == "Boss"


def test_phones_leave_card_numbers_alone(spark):
    text = "card 4785380592391139 ip 152.143.123.131 call +1 (743) 555-3824 or 743-555-3824 or 212.555.0199."
    assert one(spark, H.phones(F.col("t")), t=text) == ["+17435553824", "+12125550199"]


def test_feeds(spark):
    rss = "<rss><channel><title>T</title><description><![CDATA[D]]></description><link>http://x</link><item><title>I</title></item></channel></rss>"
    assert tuple(spark.range(1).select(feeds.feed(F.lit(rss))).first()[0]) == ("T", "D", "http://x")
    assert one(spark, feeds.feed_url(F.col("h")), h='<link rel="icon" href="i"><link rel="alternate" type="application/rss+xml" href="/f.xml">') == "/f.xml"
    assert one(spark, feeds.sitemap_urls(F.col("x")), x="<urlset><url><loc>http://a.io/") == []


def test_import_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Company_Name,WEBSITE\nA,https://a.io\n"B, Inc",b.io\nC,\nD,a.io\n')
    rows = imports.number_records(imports.read_company_csv(spark, str(tmp_path / "c.csv")))
    got = {r.source_row: (r.name, r.domain, r.outcome) for r in imports.clean_import(rows).collect()}
    assert got == {2: ("A", "a.io", "queued"), 3: ("B, Inc", "b.io", "queued"), 4: ("C", None, "empty"), 5: ("D", "a.io", "duplicate")}
    with pytest.raises(ValueError):
        imports.clean_import(spark.createDataFrame([("x", 2)], "name string, source_row long"))


def test_address_list_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" a@b.io \n\n c@d.io\n")
    found = imports.read_address_list(spark, str(tmp_path / "a.txt"))
    assert sorted(r.address for r in found.collect()) == ["a@b.io", "c@d.io"]
    tables.append(found, str(tmp_path / "t"))
    tables.append(found, str(tmp_path / "t"))
    assert tables.read(spark, str(tmp_path / "t")).count() == 4
    assert tables.json_array(found).count() == 1


def test_nested_export(spark):
    companies = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, name string")
    fields = "company_id string, address string, confidence int, source string, method string, page string, validation_status string, mx_valid boolean, is_disposable boolean, is_role_based boolean, discovered_at timestamp, is_duplicate boolean"
    emails = spark.createDataFrame([("1", "b@a.io", 50, "s", "m", "p", "valid", True, False, False, None, False), ("1", "a@a.io", 90, "s", "m", "p", "valid", True, False, False, None, False), ("1", "d@a.io", 99, "s", "m", "p", "valid", True, False, False, None, True)], fields)
    got = {r.id: [e.address for e in r.emails] for r in export_companies(companies, emails).collect()}
    assert got == {"1": ["a@a.io", "b@a.io"], "2": []}
    assert export_company(companies, emails, "9").count() == 0
    assert tuple(export_totals(export_companies(companies, emails)).first()) == (2, 2, 1)


def test_merges_keep_the_order_in_which_values_were_seen(spark):
    rows = spark.createDataFrame([("c", 2, "b"), ("c", 1, "z"), ("c", 3, "z")], "k string, o int, v string")
    assert N.union_in_order(rows, ["k"], ["o"], "v", "all").first()["all"] == ["z", "b"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, address string")
    assert validation.validate(none).count() == 0
    assert store.batch_ids(none, "id").count() == 0
    assert extraction.explode_finds(spark.createDataFrame([], "page_id long, html string"), F.col("html")).count() == 0


def test_filters_reach_the_scan_and_columns_are_pruned(spark, sf_dir):
    from siftwell.plans import catalogue

    plan = catalogue.queries()["status_page"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan and "TakeOrderedAndProject" in plan
    top = catalogue.queries()["topk_per_company"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top


def test_references_decode_as_the_standard_library_does(spark):
    import html
    import random

    from siftwell.functions import html as H

    rng = random.Random(1)
    bits = ["&amp;", "&lt;", "&#64;", "&#x40;", "&copy;", "&middot;", "&euro;", "&#8364;", "&#128;", "&#0;", "&bogus;", "&amp;lt;", "a", "@", " ", "&#643;", "&#64 ", "&", "x;", "&eacute;", "&#xD800;", "\U0001f600", "&#128512;"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(500)]
    got = spark.createDataFrame(rows, "i int, x string").select("x", H.unescape(F.col("x")).alias("y")).collect()
    assert all(r.y == html.unescape(r.x) for r in got)


def test_sections_by_class_and_bare_attributes(spark):
    from siftwell.functions import html as H

    page = '<div class="top Site-Footer x"><b>&copy; 2019</b> foo@bar.com</div><meta name=description content=hello><META NAME="a" CONTENT="1"><meta name="A" content="2">'
    r = spark.createDataFrame([(page,), ("<footer>own</footer><p class=footer>other</p>",), ("<p>none</p>",)], "h string").select(H.section_text(F.col("h"), "footer", 5000).alias("f"), H.copyright_year(H.section_text(F.col("h"), "footer", 5000)).alias("y"), H.meta(F.col("h")).alias("m")).collect()
    assert [x.f for x in r] == ["\u00a9 2019 foo@bar.com", "own", ""] and r[0].y == 2019 and r[0].m == {"description": "hello", "a": "2"}


def test_bytes_that_are_no_text_are_left_out(spark):
    import base64

    from siftwell.functions import emails as E

    code = base64.b64encode(b"write to inf\xffo@acme.io today").decode()
    (r,) = spark.createDataFrame([(f'"{code}"',)], "h string").select(E.in_base64(F.col("h")).alias("x")).collect()
    assert r.x == ["info@acme.io"]


def test_json_array_by_parts(spark, tmp_path):
    import json

    from siftwell.sources.store import write_json_array

    for n in (0, 1, 40):
        write_json_array(spark.range(n, numPartitions=5).select("id", F.when(F.col("id") % 2 == 0, "x").alias("v")), str(tmp_path / str(n)))
        text = "".join(f.read_text() for f in sorted((tmp_path / str(n)).glob("part-*")))
        assert [r["id"] for r in json.loads(text)] == list(range(n))


def test_records_are_numbered_across_partitions(spark):
    from siftwell.sources.imports import number_records

    rows = number_records(spark.range(1000, numPartitions=7).withColumnRenamed("id", "v")).collect()
    assert all(r.source_row == r.v + 2 for r in rows) and len(rows) == 1000
