"""Workers: crawl, validation and export jobs through queues, replayed batches, and progress."""

import json
import shutil
import time

from pyspark.sql import functions as F

from siftwell.streaming import jobs as J
from siftwell.streaming import queue as Q
from siftwell.streaming import workers as W


def put(spark, queue, batch, jobs):
    Q.enqueue(spark.createDataFrame([(json.dumps(j),) for j in jobs], "value string"), queue, "import", batch)


def waiting(spark, queue):
    return sorted((json.loads(r.value) for r in Q.read_all(spark, queue).collect() if r.value), key=lambda j: j["job_id"])


class Place:
    def __init__(self, tmp_path):
        self.queue, self.out, self.checkpoint, self.dead = (str(tmp_path / x) for x in ("q", "out", "cp", "dead"))

    def work(self, spark, schema, process, progress=None, worker="crawl"):
        W.run(spark, worker, self.queue, schema, process, self.out, self.checkpoint, self.dead, progress).awaitTermination(180)

    def done(self, spark):
        return spark.read.option("recursiveFileLookup", True).parquet(*[str(p) for p in __import__("pathlib").Path(self.out).glob("batch_id=*")])


def test_retries_go_back_to_the_queue_and_end_as_dead_letters(spark, tmp_path):
    p = Place(tmp_path)
    put(spark, p.queue, 0, [{"job_id": str(i), "domain": f"d{i}.io"} for i in range(4)])
    progress = W.Progress()
    spark.streams.addListener(progress)
    try:
        for _ in range(J.MAX_RETRIES + 2):  # each run takes what the last one put back
            p.work(spark, J.JOB.replace("retry_count int, ", ""), lambda b, n: b.withColumn("succeeded", F.col("job_id") != "2"), progress)
        deadline = time.time() + 30
        while progress.counts("crawl")["taken"] < 7 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert sorted(r.job_id for r in p.done(spark).collect()) == ["0", "1", "3"]
    (lost,) = waiting(spark, p.dead)
    assert lost["job_id"] == "2" and lost["retry_count"] == J.MAX_RETRIES and lost["dead_letter_source"] == "crawl"
    # a job that failed three times came four times; the listener's numbers are those of the tables
    assert progress.counts("crawl") == {"taken": 7, "done": 3, "again": 3, "dead": 1}


def test_a_batch_that_is_done_again_gives_the_same(spark, tmp_path):
    p = Place(tmp_path)
    put(spark, p.queue, 0, [{"job_id": str(i), "retry_count": 3 if i == 1 else 0} for i in range(3)])
    progress = W.Progress()
    for _ in range(2):
        p.work(spark, "job_id string", lambda b, n: b.withColumn("succeeded", F.col("job_id") == "0"), progress)
        shutil.rmtree(f"{p.checkpoint}/commits")  # as if it had failed before Spark noted the batch as done
    assert p.done(spark).count() == 1 and len(waiting(spark, p.dead)) == 1
    assert [j["retry_count"] for j in waiting(spark, p.queue) if j["job_id"] == "2"] == [0, 1]
    told = progress.counts("crawl")
    assert (told["done"], told["again"], told["dead"]) == (1, 1, 1)


def test_validation_jobs(spark, tmp_path):
    p = Place(tmp_path)
    emails = spark.createDataFrame([(1, "ann@acme.io"), (2, "info@mailinator.com"), (3, "bad@@x"), (4, "not asked@x.io")], "id long, address string")
    put(spark, p.queue, 0, [{"job_id": "a", "company_id": "c", "email_ids": ["1", "2", "99"]}, {"job_id": "b", "email_ids": ["3", "1"]}, {"job_id": "none"}])
    p.work(spark, W.VALIDATION_JOB, W.validation(lambda: emails), worker="validation")
    found = {r.job_id: {v.id: (v.validation_status, v.is_disposable, v.is_valid_syntax) for v in r.validated} for r in p.done(spark).collect()}
    assert found.keys() == {"a", "b", "none"} and found["none"] == {} and found["a"].keys() == {"1", "2"} and found["b"].keys() == {"1", "3"}
    assert found["a"]["1"] == ("valid", False, True) and found["a"]["2"][:2] == ("invalid", True) and found["b"]["3"][2] is False


def test_export_jobs(spark, tmp_path):
    p = Place(tmp_path)
    companies = spark.createDataFrame([("1", "Acme"), ("2", "Bakery")], "id string, name string")
    emails = spark.createDataFrame([("1", "a@acme.io", 90), ("1", "b@acme.io", 40)], "company_id string, address string, confidence int")
    for name in ("source", "method", "page", "validation_status"):
        emails = emails.withColumn(name, F.lit(""))
    for name in ("mx_valid", "is_disposable", "is_role_based", "is_duplicate"):
        emails = emails.withColumn(name, F.lit(False))
    emails = emails.withColumn("discovered_at", F.lit(None).cast("timestamp"))
    put(spark, p.queue, 0, [{"job_id": "all", "output_path": "all"}, {"job_id": "good", "output_path": "good", "min_confidence": 60}, {"job_id": "out", "output_path": "../x", "retry_count": 3}, {"job_id": "default"}])
    p.work(spark, W.EXPORT_JOB, W.export(lambda: companies, lambda: emails, str(tmp_path / "exports")), worker="export")
    assert sorted(r.job_id for r in p.done(spark).collect()) == ["all", "default", "good"] and [j["job_id"] for j in waiting(spark, p.dead)] == ["out"]

    def exported(name):
        return json.loads("".join(x.read_text() for x in sorted((tmp_path / "exports" / name).glob("part-*"))))

    sizes = {name: {c["name"]: [e["address"] for e in c["emails"]] for c in exported(name)} for name in ("all", "good", "output/results.json")}
    assert sizes["all"] == sizes["output/results.json"] == {"Acme": ["a@acme.io", "b@acme.io"], "Bakery": []} and sizes["good"] == {"Acme": ["a@acme.io"], "Bakery": []}
