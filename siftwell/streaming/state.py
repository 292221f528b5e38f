"""Keyed state of the job queue: one job of a domain at a time, and none within a day of the last success.

State lives in Spark's state store, keyed by domain, and its timers run on event time, so a stream that is started again from its
checkpoint goes on as if it had never stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import work_dir
from .jobs import RECENT_SECONDS

#: Seconds after which a claim ends by itself.
LOCK_SECONDS = 300
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "key string, job_id string, outcome string, at_ms long"
_STATE = "done_ms long, lock_ms long, job_id string"
#: What an instant is read as before jobs that come at the same one: a job that ends makes room for the next.
_ORDER = {"done": 0, "failed": 0, "job": 1}


class Gate(StatefulProcessor):
    """Messages of one key in order of time -> what becomes of its jobs.

    A ``job`` is ``recent`` if the key was done within the window before, ``locked`` (back to the queue as it is; no retry) while
    another job of the key is at work, else ``claimed``. ``done`` and ``failed`` end the claim of their job, and only ``done`` counts
    as recent. A claim that has not ended when its lock runs out is ``expired``: the job goes back without a retry, too.
    """

    def __init__(self, window: int = RECENT_SECONDS, lock: int = LOCK_SECONDS):
        self.window, self.lock = window * 1000, lock * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", _STATE)

    def _load(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, None]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, lock, held = self._load()
        out: list[tuple] = []
        messages = pd.concat(list(rows))
        messages = messages.assign(turn=messages["kind"].map(_ORDER)).sort_values(["at_ms", "turn", "job_id"], kind="stable")
        for job, kind, at in zip(messages["job_id"], messages["kind"], messages["at_ms"].astype(int), strict=True):
            if held is not None and lock <= at:
                out.append((key[0], held, "expired", lock))
                held = None
            if kind != "job":
                held = None if held == job else held
                if kind == "done":
                    done = at if done is None else max(done, at)
                continue
            if done is not None and at - done < self.window:
                outcome = "recent"
            elif held is not None:
                outcome = "locked"
            else:
                outcome, held, lock = "claimed", job, at + self.lock
            out.append((key[0], job, outcome, at))
        self._keep(done, lock if held is not None else None, held)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        done, lock, held = self._load()
        out = []
        if held is not None and lock <= now:
            out.append((key[0], held, "expired", lock))
            held = lock = None
        if done is not None and now - done >= self.window:
            done = None
        self._keep(done, lock, held)
        yield self._table(out)

    def _keep(self, done: int | None, lock: int | None, held: str | None) -> None:
        """State and a timer for what ends next; a key of which nothing is known any more takes no room."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if done is None and held is None:
            self.state.clear()
            return
        self.state.update((done, lock, held))
        ends = ([lock] if held is not None else []) + ([done + self.window] if done is not None else [])
        self.handle.registerTimer(min(ends))

    @staticmethod
    def _table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "job_id", "outcome", "at_ms"]).astype({"key": object, "job_id": object, "outcome": object, "at_ms": "int64"})

    def close(self) -> None:
        pass


def gate(messages: DataFrame, key: str, job: str, kind: str, at: str, window: int = RECENT_SECONDS, lock: int = LOCK_SECONDS, late: str = "10 minutes") -> DataFrame:
    """messages(key, job, kind: job, done or failed, at: timestamp), a stream -> key, job_id, outcome, at_ms for each job, and for each
    claim that ran out. Messages later than ``late`` behind the newest are left out, as Spark does; null keys and kinds have no part.

    The session has to use a state store with timers: ``spark.sql.streaming.stateStore.providerClass`` = ``STATE_STORE``.
    """
    named = messages.select(F.col(key).cast("string").alias("key"), F.col(job).cast("string").alias("job_id"), F.col(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"))
    named = named.where(F.col("key").isNotNull() & F.col("kind").isin(*_ORDER) & F.col("at").isNotNull()).withWatermark("at", late)
    # the process that sets up the state may not see this package, so its class travels by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = named.withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Gate(window, lock), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


def run_gate(messages: DataFrame, out: str, checkpoint: str, key: str, job: str, kind: str, at: str, **options) -> StreamingQuery:
    """Starts ``gate`` over what has come so far, with its outcomes appended to ``out``; the same ``checkpoint`` goes on where it stopped.
    The state store is set for this stream alone."""
    conf, name = messages.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        outcomes = gate(messages, key, job, kind, at, **options)
        return outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def gate_files(spark: SparkSession, files: DataFrame, folder: str, select: list[Column], **options) -> DataFrame:
    """The outcomes of all message files of a folder, read as a stream; ``files`` gives their schema. select: key, job, kind, at."""
    at = work_dir(spark, "gate")
    messages = spark.readStream.schema(files.schema).parquet(folder).select(*[c.alias(n) for c, n in zip(select, ("key", "job", "kind", "at"), strict=True)])
    run_gate(messages, f"{at}/out", f"{at}/checkpoint", "key", "job", "kind", "at", **options).awaitTermination()
    return spark.read.schema(OUTCOMES).parquet(f"{at}/out")
