"""The job queue as a Spark data source: ``format("siftwell_queue")``, for streams and batches, reading and writing.

A queue is a folder that all executors see. Tasks write files of lines; what makes them part of the queue is a manifest that the commit
of a batch puts into ``commits``, named by who wrote it and the batch's number. Files of tasks that failed, or of a batch whose commit
never came, are in no manifest and so in no queue, and a batch that is written again after a crash replaces its own manifest: no job is
lost or doubled. Readers keep for each writer the last batch they have read; that is their offset.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "siftwell_queue"
_MANIFEST = re.compile(r"(.+)-(\d{12})\.json")


class _Folder:
    """Files of a queue's folder, wherever it lies."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def read(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside its place, then moved there."""
        at, beside = f"{self.root}/{name}", f"{self.root}/_open/{uuid.uuid4().hex}"
        for folder in (at, beside):
            self.fs.create_dir(folder.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(beside) as f:
            f.write(text.encode())
        self.fs.move(beside, at)

    def batches(self) -> dict[str, dict[int, str]]:
        """writer -> batch number -> name of its manifest."""
        from pyarrow import fs

        out: dict[str, dict[int, str]] = {}
        for x in self.fs.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True)):
            if m := _MANIFEST.fullmatch(x.base_name):
                out.setdefault(m[1], {})[int(m[2])] = f"commits/{x.base_name}"
        return out

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class _File(InputPartition):
    name: str


class _Write:
    """What the batch and the stream writer share. ``writer`` names who writes; ``most`` bounds the rows of a file."""

    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer", "jobs")
        if not re.fullmatch(r"[A-Za-z0-9_]+", self.writer):
            raise ValueError("a writer's name is of letters, digits and underscores")

    def write(self, rows: Iterator) -> _Written:
        lines = [r[0] for r in rows if r[0] is not None]
        if not lines:
            return _Written(None, 0)
        name = f"data/{uuid.uuid4().hex}.txt"
        _Folder(self.path).write(name, "".join(f"{json.dumps(x)}\n" for x in lines))
        return _Written(name, len(lines))

    def _commit(self, messages: list, batch: int) -> None:
        kept = [m for m in messages if m is not None and m.file]
        _Folder(self.path).write(f"commits/{self.writer}-{batch:012d}.json", json.dumps({"files": [m.file for m in kept], "rows": sum(m.rows for m in kept)}))

    def _abort(self, messages: list) -> None:
        folder = _Folder(self.path)
        for m in messages:
            if m is not None and m.file:
                folder.delete(m.file)


class _BatchWriter(_Write, DataSourceWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.batch = int(options["batch"])

    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamWriter(_Write, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class _Read:
    def __init__(self, options: dict):
        self.path = options["path"]

    def _files(self, manifests: list[str]) -> list[InputPartition]:
        folder = _Folder(self.path)
        return [_File(name) for m in manifests for name in json.loads(folder.read(m))["files"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        for line in _Folder(self.path).read(partition.name).splitlines():
            yield (json.loads(line),)


class _BatchReader(_Read, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._files([m for batches in _Folder(self.path).batches().values() for _, m in sorted(batches.items())]) or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return super().read(partition) if partition.name else iter(())


class _StreamReader(_Read, DataSourceStreamReader):
    """Offsets are {writer: last batch}. ``batches``: how many batches of each writer one micro-batch takes at most."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("batches", 1 << 40))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {w: max(b) for w, b in _Folder(self.path).batches().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        held = _Folder(self.path).batches()
        return self._files([m for w, last in sorted(end.items()) for n, m in sorted(held.get(w, {}).items()) if start.get(w, -1) < n <= last])

    def commit(self, end: dict) -> None:
        """Read batches stay in the folder; ``clear`` removes them."""


class QueueSource(DataSource):
    """Options: path; writer (name of who writes) and, for batches, batch (its number)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session. Its classes travel by value: the processes that plan a read may not see this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(QueueSource)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a queue as a stream."""
    register(spark)
    return spark.readStream.format(FORMAT).option("path", path).load()


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """value: all committed lines of a queue."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()


def enqueue(lines: DataFrame, path: str, writer: str, batch: int) -> None:
    """Appends lines(value) to a queue as one batch of ``writer``. The same batch again replaces itself."""
    register(lines.sparkSession)
    lines.select(F.col("value").cast("string")).write.format(FORMAT).option("path", path).option("writer", writer).option("batch", batch).mode("append").save()
