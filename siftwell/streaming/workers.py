"""Workers of the queues: crawl, validation and export jobs through streams, with retries, dead letters and progress.

A worker reads a queue as a stream and hands each micro-batch to a process. What a batch gives lies in a folder, and in batches of
other queues, that bear its number, so a batch that is done again after a crash replaces what it gave before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.validation import validate
from ..plans.export import export_companies
from ..sources.store import write_json_array
from . import jobs as J
from . import queue as Q

VALIDATION_JOB = "job_id string, company_id string, email_ids array<string>, enqueued_at timestamp"
EXPORT_JOB = "job_id string, output_path string, min_confidence int, enqueued_at timestamp"
_VALIDATED = ["is_valid_syntax", "is_valid_domain", "mx_valid", "smtp_valid", "is_disposable", "is_role_based", "confidence", "validation_status", "notes"]


class Progress(StreamingQueryListener):
    """Counts of the streams that it listens to, by worker: jobs ``taken`` (as Spark reports each micro-batch) and, noted by the worker,
    ``done``, ``again`` and ``dead``. A batch that is done again counts once."""

    def __init__(self) -> None:
        self._taken: dict[str, dict[int, int]] = {}
        self._told: dict[str, dict[int, dict[str, int]]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            if name.startswith("taken_"):
                self._taken.setdefault(name.removeprefix("taken_"), {})[event.progress.batchId] = row["jobs"]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def note(self, worker: str, batch: int, counts: dict[str, int]) -> None:
        self._told.setdefault(worker, {})[batch] = counts

    def counts(self, worker: str) -> dict[str, int]:
        told = self._told.get(worker, {}).values()
        return {"taken": sum(self._taken.get(worker, {}).values())} | {k: sum(t[k] for t in told) for k in ("done", "again", "dead")}


def run(
    spark: SparkSession, worker: str, queue: str, schema: str, process: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, dead: str, progress: Progress | None = None, most_retries: int = J.MAX_RETRIES
) -> StreamingQuery:
    """Works off what a queue holds. process(jobs, batch number) gives the jobs with ``succeeded`` and any more columns.

    Jobs that succeeded go to ``out``/batch_id=.., the others back to the queue with one retry more, or, after ``most_retries``, to the queue ``dead`` with
    where they came from. Lines that are no JSON have null fields and are handed to the process, too. What is put back is taken by the next run.
    """
    lines = Q.read_stream(spark, queue)
    jobs = lines.select(F.from_json("value", f"{schema}, retry_count int").alias("j")).select("j.*").withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))
    jobs = jobs.observe(f"taken_{worker}", F.count(F.lit(1)).alias("jobs"))

    def step(batch: DataFrame, number: int) -> None:
        taken = batch.persist()  # the batch is counted and worked on from one read
        seen = Observation()
        good = F.coalesce("succeeded", F.lit(False))
        worked = process(taken, number).observe(seen, F.count_if(good).alias("done"), F.count_if(~good & (F.col("retry_count") < most_retries)).alias("again"), F.count_if(~good & (F.col("retry_count") >= most_retries)).alias("dead"))
        at = f"{out}/_worked/batch_id={number}"
        worked.write.mode("overwrite").parquet(at)
        worked = spark.read.schema(worked.schema).parquet(at)
        worked.where(good).write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        retry, lost = J.split_retries(worked.where(~good).select(*batch.columns), most_retries, worker)
        Q.enqueue(J.job_json(retry), queue, f"{worker}_again", number)
        Q.enqueue(J.job_json(lost), dead, worker, number)
        if progress is not None:
            progress.note(worker, number, seen.get)
        taken.unpersist()

    return jobs.writeStream.queryName(f"siftwell_{worker}").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def validation(emails: Callable[[], DataFrame], **facts: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """A process for jobs with ``email_ids``: each id that ``emails`` (id, address) holds is validated, others are passed over. A job succeeds with
    ``validated``: array of id and the fields of a validation. An id that many jobs name is validated once."""

    def process(jobs: DataFrame, number: int) -> DataFrame:
        wanted = jobs.select("job_id", F.explode("email_ids").alias("id"))
        held = emails().select(F.col("id").cast("string").alias("id"), "address").join(wanted.select("id").distinct(), "id", "left_semi")
        found = validate(held, **facts).withColumnRenamed("validation_score", "confidence").select("id", F.struct("id", *_VALIDATED).alias("v"))
        told = wanted.join(found, "id").groupBy("job_id").agg(F.array_sort(F.collect_list("v"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("validated"))  # as many as the job lists
        return jobs.join(told, "job_id", "left").withColumn("validated", F.coalesce("validated", F.array().cast(told.schema["validated"].dataType))).withColumn("succeeded", F.col("job_id").isNotNull())

    return process


def export(companies: Callable[[], DataFrame], emails: Callable[[], DataFrame], folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """A process for jobs with ``output_path`` and ``min_confidence``: each distinct pair of a batch is one export of all companies as a JSON array
    below ``folder``. A path that leaves the folder fails its job. A micro-batch holds a few such jobs, so they are run one after the other."""

    def process(jobs: DataFrame, number: int) -> DataFrame:
        named = jobs.withColumn("output_path", F.coalesce("output_path", F.lit("output/results.json"))).withColumn("min_confidence", F.coalesce("min_confidence", F.lit(0)))
        safe = ~F.col("output_path").rlike(r"(^/)|(^|/)\.\.(/|$)|:")
        wanted = sorted({(r.output_path, r.min_confidence) for r in named.where(safe).select("output_path", "min_confidence").distinct().toLocalIterator()})
        for path, least in wanted:
            write_json_array(export_companies(companies(), emails(), least), f"{folder}/{path}")
        return named.withColumn("succeeded", safe)

    return process
