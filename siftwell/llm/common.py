"""What the operators share: inputs, intermediate tables in the shared folder, and batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir

#: Bytes of text that a numpy step works on at once. One longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch while ``save`` writes: a batch of long texts then leaves room for what is made of it.
BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's Arrow batches have ``BATCH_ROWS`` rows at most in here, and what they had before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with setting(spark, name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)):
        yield


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting of that name is ``value`` in here, and what it was before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Whether Spark removes the shuffle files of a query as soon as it has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut and lost executors cost nothing that was written.
    Without ``dictionary`` for columns of hashes, which hardly repeat. What was shuffled for it goes when it is written."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with small_batches(spark), setting(spark, CLEANUP, "true"):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_at = path
    return saved


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``save`` that nothing reads any more."""
    for df in tables:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(hadoop).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most. Spark bounds a batch by its bytes; this bounds what is made of it in Python."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (a null is empty), without copying."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("")
        offset_type = np.int64
    else:
        column, offset_type = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=offset_type)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def release() -> None:
    """Give memory that is free in a Python worker back to the system: workers live on between stages, and keep what each needed most."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such C library, memory stays
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batch: pa.RecordBatch, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a batch that hold at most so many bytes each, or one row. Memory is given back after the batch."""
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
    release()
