"""Small inputs for operators that the driver's tables do not exercise; all addresses and sites are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = [
    (1, 'www.acme-plumbing.com', 'https://www.acme-plumbing.com/', '<html><head><title>Acme &amp; Sons</title><meta name="description" content="Pipes mended."><meta name="viewport" content="width=device-width"><script>var k="https://abc@o1.ingest.acme.dev/1"; var m="dev@acme-plumbing.com";</script></head><body><header>Call us hq@acme-plumbing.com</header><a href="mailto:Info@Acme-Plumbing.com?subject=x">mail</a> <!-- old: web@oldhost.net --> <a href="https://www.linkedin.com/company/acme/">in</a><script src="/wp-content/x.js"></script><script src="https://js.stripe.com/v3"></script><footer>© 2015 Acme, hq@acme-plumbing.com</footer></body></html>'),
    (2, 'www.acme-plumbing.com', 'https://www.acme-plumbing.com/contact', '<html><body>Write to sales [at] acme-plumbing [dot] com or bob (at) mail (dot) acme (dot) com <span data-cfemail="543731263114312c35392438317a373b39"></span><a href="/cdn-cgi/l/email-protection#5431393d38142c7a3b26">x</a><a href="https://twitter.com/acme?x=1">t</a> <a href="https://github.com/acme-co/">g</a></body></html>'),
    (3, 'bakery.example.org', 'http://bakery.example.org/about', '<html><head><title></title></head><body><script>var b="aW5mb0BiYWtlcnktaG91c2Uub3JnIGFuZCBtb3Jl"; var c="notbase64notbase64notb";</script><p>Open daily. reach me at home dot now</p><img src="https://cdn.shopify.com/a.png"><div>googletagmanager.com GTM-1</div></body></html>'),
    (4, 'empty.example.net', 'https://empty.example.net/', ''),
    (5, 'odd.example.net', 'https://odd.example.net/team', '<span data-cfemail="543"></span><span data-cfemail="5437312631"></span> plain text "quoted"@odd-names.com and a..b@odd-names.com and <x@odd-names.com>'),
]
#: page_id, domain, url, fetched with success, html: references, structured data, classes that name sections, OpenGraph, feeds.
RICH_PAGES = [
    (1, 'acme.io', 'https://acme.io/', False, '<html><head><title>Not fetched</title></head></html>'),
    (2, 'acme.io', 'https://acme.io/', True, '<html><head><title>Acme &mdash; Caf&eacute; &amp; more</title><meta property="og:site_name" content="Acme &amp; Co"><meta property="og:description" content="Good things"><meta name=keywords content=things><link rel="alternate" type="application/rss+xml" href="/feed.xml"><script type="application/ld+json">{"@type": "Organization", "name": "Acme Ltd", "email": "hello@acme.io", "telephone": "(212) 555-0100", "contactPoint": [{"email": "desk@acme.io"}, "mail@acme.io"], "founder": {"@type": "Person", "Email": "Ann Lee <ann@acme.io>"}}</script></head><body><a href="mailto:info&#64;acme.io">a</a><a href="mailto:sales&#x40;acme.io?subject=x">b</a><div class="site-header wide">Head &#38; top@acme.io</div><div class="site-footer">&copy; 2019 Acme, foot&commat;acme.io</div></body></html>'),
    (3, 'acme.io', 'https://acme.io/contact', True, '<html><head><script type="application/ld+json">{"name": "No type", "contactPoint": {"email": "hidden@acme.io"}}</script><script type="application/ld+json">not json</script></head><body><FOOTER>Copyright 2012, late@acme.io</FOOTER></body></html>'),
    (4, 'bakery.org', 'http://bakery.org/', True, ''),
    (5, 'bakery.org', 'http://bakery.org/', True, '<html><head><title>Bakery</title><meta name="description" content="Bread &lt;daily&gt;"><link href="/atom" type="application/atom+xml" rel="alternate"></head><body>Call 212-555-0199 or write to bread@bakery.org</body></html>'),
]
FEEDS = [(1, '<rss><channel><title>News &amp; more</title><description><![CDATA[All of it]]></description><link>https://acme.io/news</link><item><title>First</title></item></channel></rss>'), (2, '<feed><title>Atom title</title><entry><title>E</title></entry></feed>'), (3, '<html></html>')]
ADDRESSES = [" Info@Acme-Plumbing.com ", "bob.smith@acme-plumbing.com", "joe@mailinator.com", "x@example.com", "no-at-sign", "two@@signs.com", "a@b", "user@-bad.com", "sales@shop-front.de", "a/b@slash.io", "x" * 65 + "@long.com", "ok@sub.domain.co.uk", "", "noreply@unreachable.org", "refused@bounce.net", "ann@nomx.io"]
MX = [("acme-plumbing.com", "mx1.acme-plumbing.com"), ("mailinator.com", "mx.mailinator.com"), ("shop-front.de", "mx.shop-front.de"), ("bounce.net", "mx.bounce.net"), ("unreachable.org", "mx.unreachable.org")]
DNS = [("unreachable.org", False), ("acme-plumbing.com", True)]
SMTP = [("refused@bounce.net", False), ("bob.smith@acme-plumbing.com", True)]
SIGNALS = [("mailto", True, False, True, True, False, False), ("html_regex", False, False, False, False, True, False), ("footer", False, False, True, False, False, True), ("cloudflare_decode", False, False, False, False, False, False), ("html_comment", False, False, False, False, False, False), ("ocr", False, False, False, False, False, False), ("ocr", False, True, False, False, True, True), ("unheard_of", False, True, True, True, False, False)]
URLS = ["https://acme.com/contact", "http://acme.com/search?q=1", "http://localhost/x", "http://192.168.1.4/", "http://169.254.169.254/latest", "ftp://acme.com/f", "https://acme.com/../etc", "https://acme.com//evil.com", "", "https://dotless/path", "HTTPS://User@ACME.com:8443/About/?b=2#frag", "acme.com/team/", "https://172.20.1.1/", "https://acme.com/x<script>", "  https://acme.com/a/b///  ", "https://www.google.com/maps/place/x", "https://goo.gl/abc", "http://metadata.aws.internal/a", "https://", "mailto:a@b.co"]
DOMAINS = ["https://www.Acme.com/path?x=1", "acme.com.", "example.com", "http://acme.com:8080/", "  WWW.shop-front.de#top", "no_dots", "", "sub.acme.co.uk/", "https://http://acme.com", "-bad-.com", "acme.c", "https://maps-0123456789abcdef.pending"]
COMPANY_CSV = [("Acme", "https://www.acme.com/"), ("  Bakery  House ", "bakery.org"), ("Acme again", "acme.com"), ("Nothing", ""), ("Bad", "not a domain"), ("Map", "https://www.google.com/maps/place/abc"), (None, "http://test.com"), ("Long" * 200, "long-name.net"), ("Known", "known.com"), ("Port", "http://acme.com:80")]
STORED = ["known.com", "other.com"]
# rules of all three kinds, and hosts under each
SUFFIX_RULES = ["com", "org", "net", "io", "uk", "co.uk", "gov.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "github.io", "br", "com.br"]
SUFFIX_HOSTS = ["www.acme.com", "acme.com", "com", "a.b.co.uk", "co.uk", "bbc.uk", "www.ck", "x.www.ck", "shop.co.ck", "deep.shop.co.ck", "co.ck", "ck", "city.kawasaki.jp", "a.city.kawasaki.jp", "x.y.kawasaki.jp", "y.kawasaki.jp", "user.github.io", "a.user.github.io", "github.io", "WWW.Loja.COM.BR.", "unknown.zz", "10.1.2.3", "[::1]", "", None]
MAPS = [(1, "https://www.google.com/maps/a", "https://www.acme.com/"), (2, "https://goo.gl/b", None), (3, "https://goo.gl/c", "http://acme.com"), (4, "https://goo.gl/d", "https://known.com/x"), (5, "https://goo.gl/e", "https://new-site.io")]
SITEMAPS = [
    ("https://acme.com", 2, '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://acme.com/blog</loc></url><url><loc> https://acme.com/contact </loc></url><url><loc>http://localhost/x</loc></url></urlset>'),
    ("https://acme.com", 1, "<urlset></urlset>"),
    ("https://acme.com", 3, "<urlset><url><loc>https://acme.com/never</loc></url></urlset>"),
    ("https://bakery.org", 1, "<urlset><url><loc>https://bakery.org/a"),
    ("https://bakery.org", 2, "<urlset><url><loc>https://bakery.org/a?b=1&amp;c=2</loc></url><url><loc>https://bakery.org/team</loc></url><url><loc>https://bakery.org/team</loc></url></urlset>"),
]
ROBOTS = [("https://acme.com", "User-agent: *\nSITEMAP: ftp://x\nSitemap: https://acme.com/s.xml\nSitemap: https://acme.com/t.xml"), ("https://bakery.org", "User-agent: *\nDisallow: /")]
HEADERS = [(1, {"CF-Ray": "1", "Server": "Apache/2"}), (2, {"server": "nginx", "X-Powered-By": "PHP/8 WordPress"}), (3, {"via": "x"})]
SUMMARIES = [(1, " Pipes mended. ", "Mending|Fitting||Welding|A|B|C|D", "Trade", None), (2, None, "", None, "Food"), (3, "", "", "", ""), (4, "x" * 790, "Long services", None, None)]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(x)}" for k, x in v.items()) + "}"
    return f"{v}::bigint" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list, columns: str) -> str:
    """The same rows as a DuckDB relation."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(select * from (values {body}) v({columns}))"
