import json

from pyspark.sql import functions as F

from siftwell.streaming import jobs as J


def test_recent_repeats_are_suppressed_after_the_last_kept_row(spark):
    hour = 3600
    rows = [("a", 0), ("a", 23 * hour), ("a", 25 * hour), ("a", 48 * hour), ("a", 49 * hour), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, s long")
    assert sorted(map(tuple, J.suppress_recent(df, "k", "s").collect())) == [("a", 0), ("a", 25 * hour), ("a", 49 * hour), ("b", 5)]


def test_token_bucket(spark):
    df = spark.createDataFrame([("h", 0, i) for i in range(7)] + [("h", 10, 7)], "k string, s long, i int")
    waits = [r.wait for r in J.token_bucket(df, "k", "s", 5.0, "i").orderBy("i").collect()]
    assert waits[:5] == [0.0] * 5 and abs(waits[5] - 0.2) < 1e-9 and abs(waits[6] - 0.4) < 1e-9 and waits[7] == 0.0


def test_retries(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "job int, retry_count int")
    again, dead = J.split_retries(df)
    assert sorted(r.retry_count for r in again.collect()) == [1, 2, 3]
    assert {r.dead_letter_source for r in dead.collect()} == {"crawl"} and dead.count() == 2


def test_worker(spark, tmp_path):
    (tmp_path / "in").mkdir()
    jobs = [{"job_id": str(i), "domain": f"d{i}.io", "retry_count": 3 if i == 2 else 0} for i in range(4)]
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, jobs)))
    queue = J.read_queue(spark, str(tmp_path / "in"))
    q = J.run_worker(queue, lambda b: b.withColumn("succeeded", F.col("job_id").cast("int") % 2 == 1), *(str(tmp_path / x) for x in ("out", "cp", "again", "dead")))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [json.loads(r.value)["retry_count"] for r in spark.read.text(str(tmp_path / "again")).collect()] == [1]
    assert [json.loads(r.value)["job_id"] for r in spark.read.text(str(tmp_path / "dead")).collect()] == ["2"]


def test_job_defaults(spark):
    df = spark.createDataFrame([('{"job_id":"1"}',)], "value string")
    r = J.parse_jobs(df).first()
    assert (r.priority, r.retry_count, r.domain) == (5, 0, None)


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(json.dumps({"job_id": str(i), "domain": "d"}) for i in range(6)))
    places = [str(tmp_path / x) for x in ("out", "cp", "again", "dead")]
    for _ in range(2):
        J.run_worker(J.read_queue(spark, str(tmp_path / "in")), lambda b: b.withColumn("succeeded", F.col("job_id").cast("int") > 1), *places).awaitTermination(120)
        shutil.rmtree(tmp_path / "cp" / "commits")  # as if it had failed before the batch was committed
    assert spark.read.parquet(places[0]).count() == 4 and spark.read.text(places[2]).count() == 2


def test_only_success_counts_as_recent(spark):
    jobs = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "k string, now long")
    done = spark.createDataFrame([("a", 50), ("a", 95), ("b", 10)], "k string, at long")
    assert sorted(r.k for r in J.not_recent(jobs, done, "k", "now", "at", 80).collect()) == ["b", "c"]


def test_one_job_of_a_key_is_claimed(spark):
    jobs = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, v string")
    mine, back = J.claim(jobs, "k", ["n"])
    assert sorted(map(tuple, mine.collect())) == [("a", 1, "y"), ("b", 5, "z")] and sorted(map(tuple, back.collect())) == [("a", 2, "x")]


def test_health(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    assert J.health(spark, {"store": str(tmp_path / "t")}) == {"store": "ok", "overall": "healthy"}
    said = J.health(spark, {"store": str(tmp_path / "missing")})
    assert said["store"].startswith("error") and said["overall"] == "unhealthy"
