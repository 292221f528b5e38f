"""Places in a total order, keyset pages, bounded lists of a site's pages."""

import random

from pyspark.sql import functions as F

from siftwell.operators import enrichment as N
from siftwell.operators import numbering, store


def test_places_in_an_order_of_text_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "Ä", None, "aa"]), rng.choice([1.5, -2.0, None]), i) for i in range(500)]
    rng.shuffle(rows)
    got = numbering.numbered(spark.createDataFrame(rows, "t string, x double, i int"), ["t", "x", "i"], ranges=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    assert [(r.t, r.x, r.i) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 501))


def test_a_dense_part_of_the_order_spreads_over_all_tasks(spark):
    # nine tenths of the keys lie in a thousandth of the range
    keys = spark.range(0, 20000, 1, 4).select(F.when(F.col("id") % 10 == 0, F.col("id") * 1000).otherwise(F.col("id")).alias("k"))
    dealt = keys.repartitionByRange(8, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 20000 / 8
    got = numbering.numbered(keys, ["k"], ranges=8)
    ranks = {k: n for n, k in enumerate(sorted(r.k for r in keys.collect()), 1)}
    assert all(ranks[r.k] == r.place for r in got.collect())


def test_batches_of_any_order(spark):
    df = spark.createDataFrame([(f"key{i:03d}", i) for i in range(250)], "k string, i int")
    batches = {r.k: r.batch_id for r in store.batch_ids(df, "k", 100).collect()}
    assert all(batches[f"key{i:03d}"] == i // 100 + 1 for i in range(250))
    twice = store.batch_ids(df.unionByName(df), ["k", "i"], 50).groupBy("batch_id").count().collect()
    assert {r["count"] for r in twice} == {50} and len(twice) == 10
    assert store.batch_ids(df.limit(0), "k").count() == 0


def test_keyset_pages_give_the_whole_order_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice("xyz"), i) for i in range(230)]
    spark.createDataFrame(rows, "a int, b string, i int").write.parquet(str(tmp_path / "t"))
    df, order, seen, last = spark.read.parquet(str(tmp_path / "t")), ["a", "b", "i"], [], None
    while page := numbering.page_after(df, order, last, 40).collect():
        seen += [tuple(r) for r in page]
        last = seen[-1]
    assert seen == sorted(rows)
    plan = numbering.page_after(df, order, (3, "y", 7), 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,3)" in plan and "TakeOrderedAndProject" in plan


def test_pages_of_a_site_are_bounded_before_the_shuffle(spark):
    urls = [("https://big.io", f"https://big.io/p{i:04d}") for i in range(300)] + [("https://big.io", f"https://big.io/contact/{i}") for i in range(4)] * 2 + [("https://odd.io", "ftp://odd.io/x"), ("https://one.io", "https://one.io/a")]
    df = N.site_pages(spark.createDataFrame(urls, "base string, url string"), "base", "url", 50)
    found = {r.base: r.urls for r in df.collect()}
    assert found["https://big.io"] == [f"https://big.io/contact/{i}" for i in range(4)] + [f"https://big.io/p{i:04d}" for i in range(46)]
    assert found["https://odd.io"] is None and found["https://one.io"] == ["https://one.io/a"]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
