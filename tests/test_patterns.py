"""Many patterns at once against each pattern by itself."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftwell.functions import constants as C
from siftwell.functions import html as H
from siftwell.functions import patterns as P

RULES = [rx for *_, rx in C.TECHNOLOGIES]


@pytest.mark.parametrize(
    "pattern, run, whole",
    [
        (r"cdn\.shopify\.com", "cdn.shopify.com", True), (r"UA-\d{6,9}-\d", "ua-", False), (r"Intercom\(", "intercom(", True), (r"colou?r", "colo", False), (r"ab[xyz]cdef", "cdef", False),
        (r"a(?:bc|de)fgh", "fgh", False), (r"x+yz", "yz", False), (r"stripe\.com/v\d", "stripe.com/v", False), (r"[abc]+", "", False), (r"ab{2,3}cd", "cd", False), (r"a\sbc", "bc", False),
    ],
)
def test_required_runs(pattern, run, whole):
    got = P.literal(pattern)
    assert got == (run, whole)


def test_alternatives():
    assert P.alternatives(r"a\|b|c[|]d|(e|f)g") == [r"a\|b", "c[|]d", "(e|f)g"]


def texts(n: int) -> list[str | None]:
    rng = random.Random(7)
    parts = ["wp-content", "WP-INCLUDES", "/wp-json/", "Shopify.theme", "ga.js", "UA-1234567-1", "UA-12-1", "ua-123456-9", "jquery-3", "jquery-x", "stripe.com/v3", "stripe.com/vx", "Joomla!", "é", "K", "İ", " ", "<p>", "force.com", "sales", "xpiwik.js", "mc.js", "GTM-", "gtm-"]
    return [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]]


@pytest.mark.parametrize("automaton", [True, False])
def test_patterns_equal_each_by_itself(monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(P, "ahocorasick", None)
    extra = [*RULES, r"[0-9]{3}", r"colou?r|sales", r"x+yz|(?:ga|mc)\.js"]
    rules = P.Patterns(extra)
    assert (rules.automaton is not None) == (automaton and P.ahocorasick is not None)
    for t in texts(600):
        assert rules.match(t) == [i for i, rx in enumerate(extra) if t and re.search(rx, t, re.I | re.A)]


def test_matching_equals_rlike(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(300))], "id int, t string")
    one_by_one = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?i)" + rx), i) for i, rx in enumerate(RULES)]))
    rows = df.select(P.matching(F.col("t"), RULES).alias("got"), one_by_one.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(map(bool, (r.got for r in rows))) > 100


def test_headers_come_after_pages_and_names_count_once(spark):
    df = spark.createDataFrame([("x wp-content cloudflare.com", {"CF-Ray": "1", "Server": "Nginx", "x-powered-by": "WordPress"}), (None, {"server": "apache"}), ("", {})], "html string, headers map<string,string>")
    found = [[(t.name, t.detection) for t in r.t] for r in df.select(H.technologies(F.col("html"), F.col("headers")).alias("t")).collect()]
    assert found == [[("WordPress", "html"), ("Cloudflare", "html"), ("Nginx", "header")], [("Apache", "header")], []]


def test_time_hardly_depends_on_the_number_of_patterns():
    if P.ahocorasick is None:
        pytest.skip("no automaton here")
    text = "".join(random.Random(1).choices("abcdefgh <>/=\"", k=200_000))

    def seconds(n: int) -> float:
        rules = P.Patterns([*RULES, *[rf"marker{i}\.example\d" for i in range(n)]])
        rules.match(text)
        start = time.perf_counter()
        for _ in range(5):
            rules.match(text)
        return time.perf_counter() - start

    assert min(seconds(2000) for _ in range(3)) < 4 * max(seconds(0) for _ in range(3))
