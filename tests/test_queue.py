"""The queue connector: what is committed is there once, what is not is not there at all."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from siftwell.streaming import queue as Q


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def held(spark, path):
    return sorted(r.value for r in Q.read_all(spark, path).collect() if r.value is not None)


def drain(spark, source, out, checkpoint):
    """Copies a queue to another as a stream, as far as it goes."""
    Q.register(spark)
    q = Q.read_stream(spark, source).select(F.concat(F.lit("seen "), "value").alias("value"))
    run = q.writeStream.format(Q.FORMAT).option("path", out).option("writer", "copy").option("checkpointLocation", checkpoint).trigger(once=True).start()
    run.awaitTermination(120)


def test_a_queue_without_batches_is_empty(spark, tmp_path):
    assert held(spark, str(tmp_path / "none")) == []


def test_batches_of_several_writers(spark, tmp_path):
    at = str(tmp_path / "q")
    Q.enqueue(lines(spark, ["a", "b\nline", 'q"uote', None, ""]).repartition(3), at, "import", 0)
    Q.enqueue(lines(spark, ["c"]), at, "again", 0)
    Q.enqueue(lines(spark, []), at, "again", 1)
    assert held(spark, at) == sorted(["a", "b\nline", 'q"uote', "", "c"])
    Q.enqueue(lines(spark, ["d"]), at, "again", 0)  # the same batch again
    assert held(spark, at) == sorted(["a", "b\nline", 'q"uote', "", "d"])
    with pytest.raises(Exception, match="letters"):
        Q.enqueue(lines(spark, ["x"]), at, "a/b", 0)


def test_files_without_a_commit_are_not_in_the_queue(spark, tmp_path):
    at = str(tmp_path / "q")
    Q.enqueue(lines(spark, ["a"]), at, "import", 0)
    Q.enqueue(lines(spark, ["lost"]), at, "import", 1)
    os.remove(f"{at}/commits/import-000000000001.json")  # as if the driver had died after the tasks wrote and before the commit
    assert len(os.listdir(f"{at}/data")) == 2 and held(spark, at) == ["a"]
    Q.enqueue(lines(spark, ["lost"]), at, "import", 1)
    assert held(spark, at) == ["a", "lost"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    Q.enqueue(lines(spark, ["1", "2"]), source, "import", 0)
    drain(spark, source, out, checkpoint)
    assert held(spark, out) == ["seen 1", "seen 2"]
    Q.enqueue(lines(spark, ["3"]), source, "import", 1)
    Q.enqueue(lines(spark, ["4"]), source, "again", 7)
    drain(spark, source, out, checkpoint)
    assert held(spark, out) == ["seen 1", "seen 2", "seen 3", "seen 4"]


def test_a_crash_between_write_and_commit_loses_and_doubles_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    Q.enqueue(lines(spark, ["1", "2"]), source, "import", 0)
    drain(spark, source, out, checkpoint)
    # Spark has noted which batch it was about to do, but not that it is done: it does the batch again
    shutil.rmtree(f"{checkpoint}/commits")
    manifest = json.loads(open(f"{out}/commits/copy-000000000000.json").read())
    drain(spark, source, out, checkpoint)
    assert held(spark, out) == ["seen 1", "seen 2"] and json.loads(open(f"{out}/commits/copy-000000000000.json").read())["files"] != manifest["files"]
    # and the same if the crash came before the queue's own commit
    shutil.rmtree(f"{checkpoint}/commits")
    os.remove(f"{out}/commits/copy-000000000000.json")
    assert held(spark, out) == []
    drain(spark, source, out, checkpoint)
    assert held(spark, out) == ["seen 1", "seen 2"]
