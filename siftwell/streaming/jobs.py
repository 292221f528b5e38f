"""The job queue as a stream: suppression of recent repeats, retries and dead letters, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

JOB = "job_id string, company_id string, domain string, priority int, retry_count int, enqueued_at timestamp, metadata map<string,string>"
RECENT_SECONDS = 24 * 3600
MAX_RETRIES = 3


def parse_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Jobs from JSON, with defaults for what is absent."""
    job = lines.select(F.from_json(column, JOB).alias("j")).select("j.*")
    return job.withColumn("priority", F.coalesce("priority", F.lit(5))).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))


def job_json(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value"))


def read_queue(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Jobs in the order of arrival; ``priority`` is carried and not used. ``files_per_trigger`` bounds the admission."""
    return parse_jobs(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def suppress_recent(events: DataFrame, key: str, seconds: str, window: int = RECENT_SECONDS) -> DataFrame:
    """Rows that come ``window`` seconds or more after the last kept row of their key; the first is kept.

    seconds: whole seconds of the event. A fold over a key's times in order, as each decision depends on the last kept one.
    """
    schema = events.schema

    ordered = events.repartition(key).sortWithinPartitions(key, seconds, *[c for c in events.columns if c not in (key, seconds)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        for rows in batches:  # a key's rows stand together, in order, however many batches they fill
            keep = []
            for k, t in zip(rows[key], rows[seconds], strict=True):
                good = last.get("k") != k or t - last["t"] >= window
                if good:
                    last = {"k": k, "t": t}
                keep.append(good)
            yield rows[keep]

    return ordered.mapInPandas(run, schema)


def split_retries(failed: DataFrame, most: int = MAX_RETRIES, source: str = "crawl") -> tuple[DataFrame, DataFrame]:
    """(jobs to queue again with one retry more, dead letters with where they came from)."""
    again = failed.where(F.col("retry_count") < most).withColumn("retry_count", F.col("retry_count") + 1)
    dead = failed.where(F.col("retry_count") >= most).withColumn("dead_letter_source", F.lit(source))
    return again, dead


def token_bucket(requests: DataFrame, key: str, seconds: str, rate: float = 5.0, order: str | None = None, chunks: int | None = None) -> DataFrame:
    """Adds ``wait``: seconds until a token is there, for each request of a key in order of time; capacity max(rate, 1).

    A request turns the tokens x before it into min(capacity, x + rate * elapsed) - 1. Such steps, of the form min(a, x + b), compose into
    one of the same form, so a run of requests is known by two numbers: how many they are, and the greatest rate * time - place in it.
    Time is cut into ``chunks`` (as many as shuffle partitions, at quantiles of all times); each chunk of a key is scanned by itself, the chunks'
    numbers are summed up along the key, and a key with all the rows still uses every task. Rows without time get no wait and use no token; rows
    of a null key share one bucket. Without ``order``, requests of one instant are taken in any order.
    """
    capacity, at = max(rate, 1.0), F.col(seconds).cast("double")
    count = chunks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = requests.where(F.col(seconds).isNotNull())
    bounds = sorted(set(timed.select(at.alias("t")).approxQuantile("t", [i / count for i in range(1, count)], 0.2 / count))) if count > 1 else []
    chunk = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < at)) if bounds else F.lit(0)

    inside = Window.partitionBy(key, "_chunk").orderBy(seconds, *([order] if order else []))
    numbered = timed.withColumn("_chunk", chunk).withColumn("_place", F.row_number().over(inside)).withColumn("_level", at * rate - F.col("_place"))
    numbered = numbered.withColumn("_top", F.max("_level").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a chunk of a key as one row, and along the key what comes before it: a prefix scan over few rows
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = numbered.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.max("_level").alias("_most"))
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.withColumn("_earlier", F.max(F.col("_most") - F.col("_offset")).over(before)).select(F.col(key).alias("_key"), F.col("_chunk").alias("_run"), "_offset", "_earlier")
    joined = numbered.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_run")))
    top = F.greatest(F.col("_earlier"), F.col("_top") - F.col("_offset"))
    left = F.lit(capacity - 1) + F.col("_level") - F.col("_offset") - top
    out = joined.withColumn("wait", F.greatest(F.lit(0.0), -left / F.lit(rate))).select(*requests.columns, "wait")
    return out.unionByName(requests.where(F.col(seconds).isNull()).withColumn("wait", F.lit(None).cast("double")))


def not_recent(jobs: DataFrame, done: DataFrame, key: str, now: str, finished: str, window: int = RECENT_SECONDS) -> DataFrame:
    """Jobs whose key was not worked on with success within ``window`` seconds before; failures do not count. done: successes, with times."""
    last = done.groupBy(key).agg(F.max(finished).alias("last_done"))
    return jobs.join(last, key, "left").where(F.col("last_done").isNull() | (F.col(now) - F.col("last_done") >= window)).select(*jobs.columns)


def claim(jobs: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one job of each key: the first by ``order``, the others): a key is worked on by one job at a time. The others go back to the
    queue as they are; that is no retry. Of jobs that agree in key and order the first by their other columns is claimed, of equal rows one; no job
    vanishes. Jobs without key are each claimed. A minimum before the shuffle, so a hot key is one row a task."""
    rest = [c for c in jobs.columns if c not in (key, *order)]
    same = jobs.groupBy(*jobs.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    joined = same.join(first, key, "left").withColumn("_mine", F.struct(*order, *rest).eqNullSafe(F.col("_first")))
    mine = joined.where("_mine").select(*jobs.columns).unionByName(jobs.where(F.col(key).isNull()))
    left = F.col("_copies") - F.col("_mine").cast("long")
    back = joined.where(F.col(key).isNotNull() & (left > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return mine, back.select(*jobs.columns)


def progress(jobs: DataFrame, status: str) -> DataFrame:
    """One row: jobs in all, by status, and the share that is done or has failed for good."""
    n = lambda name: F.count_if(F.col(status) == name)
    over = n("done") + n("failed")
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), n("queued").alias("queued"), n("crawling").alias("crawling"), n("done").alias("done"), n("failed").alias("failed"), F.round(over / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("share_over"))


def health(spark: SparkSession, tables: dict[str, str], queries: list[StreamingQuery] = ()) -> dict[str, str]:
    """Whether each table can be read and each stream is alive, and ``overall``: healthy, degraded (tables only) or unhealthy."""
    said = {}
    for name, place in tables.items():
        try:
            spark.read.parquet(place).limit(1).collect()
            said[name] = "ok"
        except Exception as e:  # whatever the store says is the answer
            said[name] = f"error: {str(e)[:100]}"
    stored = all(x == "ok" for x in said.values())
    for q in queries:
        said[q.name or str(q.id)] = "ok" if q.isActive or q.exception() is None else f"error: {str(q.exception())[:100]}"
    said["overall"] = "healthy" if all(x == "ok" for x in said.values()) else "degraded" if stored else "unhealthy"
    return said


def run_worker(jobs: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, again: str, dead: str) -> StreamingQuery:
    """Each micro-batch of jobs through ``process``, which adds ``succeeded``; results are kept, failures queued again or
    written to the dead letters. A batch that is replayed after a failure writes over what it wrote before: each has a folder of
    its own in ``out``, ``again`` and ``dead``, named by its number."""

    def step(batch: DataFrame, number: int) -> None:
        at = f"batch_id={number}"
        done = process(batch).persist()
        done.where("succeeded").write.mode("overwrite").parquet(f"{out}/{at}")
        retry, lost = split_retries(done.where("not succeeded").select(*batch.columns))
        job_json(retry).write.mode("overwrite").text(f"{again}/{at}")
        job_json(lost).write.mode("overwrite").text(f"{dead}/{at}")
        done.unpersist()

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
