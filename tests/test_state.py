"""Keyed streaming state, the token bucket by chunks, claims and public suffixes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import domains
from siftwell.streaming import jobs as J
from siftwell.streaming import state as S

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
DAY = 86400


class Folder:
    """A folder of message files, and the stream over it."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def put(self, rows):
        messages = [(k, j, kind, START + dt.timedelta(seconds=t)) for k, j, kind, t in rows]
        self.spark.createDataFrame(messages, "k string, j string, kind string, at timestamp").coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, **options) -> list[tuple]:
        stream = self.spark.readStream.schema("k string, j string, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        S.run_gate(stream, f"{self.path}/out", f"{self.path}/checkpoint", "k", "j", "kind", "at", **options).awaitTermination(180)
        origin = int(START.timestamp())
        return sorted((r.key, r.job_id, r.outcome, r.at_ms // 1000 - origin) for r in self.spark.read.schema(S.OUTCOMES).parquet(f"{self.path}/out").collect())


def test_two_batches_of_one_domain_give_one_claim(spark, tmp_path):
    q = Folder(spark, tmp_path)
    q.put([("a", "1", "job", 0), ("b", "2", "job", 5)])
    assert q.run() == [("a", "1", "claimed", 0), ("b", "2", "claimed", 5)]
    q.put([("a", "3", "job", 100)])
    assert q.run() == [("a", "1", "claimed", 0), ("a", "3", "locked", 100), ("b", "2", "claimed", 5)]


def test_a_lock_runs_out_by_itself_and_returns_the_job(spark, tmp_path):
    q = Folder(spark, tmp_path)
    q.put([("a", "1", "job", 0)])
    q.put([("other", "9", "job", 5000)])  # the newest message moves the clock; nothing comes for ``a``
    out = q.run(late="1 minute")
    assert ("a", "1", "expired", S.LOCK_SECONDS) in out and ("a", "1", "claimed", 0) in out
    q.put([("a", "2", "job", 5100)])
    assert ("a", "2", "claimed", 5100) in q.run(late="1 minute")


def test_only_success_makes_a_domain_recent_and_a_restart_remembers_it(spark, tmp_path):
    q = Folder(spark, tmp_path)
    q.put([("good", "1", "job", 0), ("bad", "2", "job", 0), ("good", "1", "done", 60), ("bad", "2", "failed", 60)])
    q.run()
    jobs = [("good", "3", "job", DAY - 200), ("bad", "4", "job", DAY - 100), ("good", "5", "job", 60 + DAY), ("new", "6", "job", 60 + DAY)]
    q.put(jobs)
    later = {r[:3] for r in q.run() if r[1] in "3456"}
    assert later == {("good", "3", "recent"), ("bad", "4", "claimed"), ("good", "5", "claimed"), ("new", "6", "claimed")}
    # the same as the batch operator says of those jobs
    offered = spark.createDataFrame([(k, j, t) for k, j, _, t in jobs], "k string, j string, t long")
    done = spark.createDataFrame([("good", 60)], "k string, at long")
    assert {r.j for r in J.not_recent(offered, done, "k", "t", "at").collect()} == {j for _, j, o in later if o == "claimed"}


def test_state_equals_a_plain_fold_in_any_number_of_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted(((rng.choice("abcd"), str(rng.randrange(4)), rng.choice(["job", "job", "job", "done", "failed"]), t) for t in rng.sample(range(0, 4000), 160)), key=lambda r: r[3])
    want, done, held = [], {}, {}
    for k, j, kind, t in rows:
        if k in held and held[k][1] <= t:
            want.append((k, held[k][0], "expired", held.pop(k)[1]))
        if kind != "job":
            if k in held and held[k][0] == j:
                held.pop(k)
            if kind == "done":
                done[k] = t
            continue
        outcome = "recent" if k in done and t - done[k] < 500 else "locked" if k in held else "claimed"
        if outcome == "claimed":
            held[k] = (j, t + 200)
        want.append((k, j, outcome, t))
    for part in range(3):
        at = tmp_path / str(part)
        q = Folder(spark, at)
        cuts = [0, *sorted(rng.sample(range(1, 160), part)), 160]
        for a, b in zip(cuts, cuts[1:], strict=False):
            q.put(rows[a:b])
            got = q.run(window=500, lock=200, late="10 seconds")
        open_ends = {(k, j, "expired", until) for k, (j, until) in held.items()}
        assert set(got) - open_ends == set(want) and len(got) == len(set(got))


def test_the_state_store_is_set_for_the_stream_alone(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    q = Folder(spark, tmp_path)
    q.put([("a", "1", "job", 0), (None, "2", "job", 1), ("b", "3", "other", 1)])
    assert q.run() == [("a", "1", "claimed", 0)] and spark.conf.get(name) == before


# -- token bucket


def brute_waits(times: list[float], rate: float) -> list[float]:
    capacity, tokens, last, out = max(rate, 1.0), max(rate, 1.0), None, []
    for t in times:
        tokens = min(capacity, tokens + (0 if last is None else t - last) * rate)
        last = t
        out.append(max(0.0, (1 - tokens) / rate))
        tokens -= 1
    return out


@pytest.mark.parametrize("rate, chunks", [(5.0, 1), (5.0, 7), (0.4, 16)])
def test_bucket_by_chunks_equals_a_fold(spark, rate, chunks):
    rng = random.Random(4)
    rows = [("hot", rng.randrange(400), i) for i in range(3000)] + [("warm", rng.randrange(4000), i) for i in range(3000, 3300)] + [("one", 7, 4000), (None, 3, 4001), (None, 3, 4002), ("none", None, 4003)]
    df = spark.createDataFrame(rows, "k string, s long, i int")
    got = {r.i: r.wait for r in J.token_bucket(df, "k", "s", rate, "i", chunks).collect()}
    want = {4003: None}
    for k in {r[0] for r in rows}:
        own = sorted((s, i) for key, s, i in rows if key == k and s is not None)
        want |= dict(zip([i for _, i in own], brute_waits([s for s, _ in own], rate), strict=True))
    assert got.keys() == want.keys() and all(w is None and got[i] is None or abs(got[i] - w) < 1e-6 for i, w in want.items())


def test_one_key_with_all_rows_uses_every_task(spark):
    df = spark.range(0, 40000, 1, 4).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 5000).alias("s"), "id")
    out = J.token_bucket(df, "k", "s", 5.0, "id", chunks=32).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 40000 and max(sizes) < 20000


def test_bucket_of_no_rows(spark):
    assert J.token_bucket(spark.createDataFrame([], "k string, s long"), "k", "s").count() == 0


# -- claims


def test_no_job_vanishes_when_jobs_agree_in_key_and_order(spark):
    rows = [("d", 1, "x"), ("d", 1, "y"), ("d", 2, "z"), ("e", 1, "q"), ("e", 1, "q"), ("e", 1, "q"), (None, 1, "n"), (None, 1, "n"), ("f", None, None)]
    mine, back = J.claim(spark.createDataFrame(rows, "k string, n int, v string"), "k", ["n"])
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, [("d", 1, "x"), ("e", 1, "q"), (None, 1, "n"), (None, 1, "n"), ("f", None, None)]))
    assert sorted(map(tuple, back.collect())) == [("d", 1, "y"), ("d", 2, "z"), ("e", 1, "q"), ("e", 1, "q")]


# -- public suffixes

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io"]


CASES = [
    ("www.acme.com", "com", "acme.com"), ("com", "com", None), ("a.b.co.uk", "co.uk", "b.co.uk"), ("bbc.uk", "uk", "bbc.uk"), ("x.www.ck", "ck", "www.ck"), ("www.ck", "ck", "www.ck"), ("shop.co.ck", "co.ck", "shop.co.ck"),
    ("co.ck", "co.ck", None), ("ck", None, None), ("a.city.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp"), ("x.y.kawasaki.jp", "y.kawasaki.jp", "x.y.kawasaki.jp"), ("u.github.io", "github.io", "u.github.io"),
    ("github.io", "github.io", None), ("A.COM.", "com", "a.com"), ("other.zz", None, None), ("1.2.3.4", None, None), ("[::1]", None, None), ("", None, None), (None, None, None),
]


def test_suffix_rules(spark):
    df = spark.createDataFrame([(c[0], n) for n, c in enumerate([*CASES, *CASES])], "host string, n int")
    out = domains.registered_domains(df, "host", spark.createDataFrame([(r,) for r in [*RULES, "com"]], "rule string"))
    assert sorted(map(str, ((r.host, r.suffix, r.registered) for r in out.collect()))) == sorted(map(str, [*CASES, *CASES]))


def test_a_default_rule_is_a_row_of_the_table(spark):
    hosts = spark.createDataFrame([("a.b.zz",), ("x.com",)], "host string")
    out = {r.host: (r.suffix, r.registered) for r in domains.registered_domains(hosts, "host", spark.createDataFrame([("*",), ("com",)], "rule string")).collect()}
    assert out == {"a.b.zz": ("zz", "b.zz"), "x.com": ("com", "x.com")}
