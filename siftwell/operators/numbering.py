"""Places in a total order, and pages of it, without one task that sees all rows.

Rows are dealt out by ranges whose bounds Spark samples from the data, so dense parts of the order spread over all tasks and any column
that sorts will do. Each range is counted, the counts are summed up over the few ranges, and a row's place is what lies before its range plus
its place inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

#: Low bits of ``monotonically_increasing_id``: the row within its task.
_ROW_BITS = (1 << 33) - 1


def numbered(df: DataFrame, order: Sequence[str], out: str = "place", ranges: int | None = None) -> DataFrame:
    """Adds ``out``: the place of each row, from 1, by the columns of ``order`` ascending, nulls first. Rows that agree in all of them
    get places in any order, and stand in one range: end ``order`` with a unique column. An empty table gives no rows.

    The ranges are written to the shared folder once, so that counts and places are of the same ones even if an executor is lost.
    """
    spark = df.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    at = work_dir(spark, "ranges")
    dealt.write.parquet(at)
    dealt = spark.read.schema(dealt.schema).parquet(at)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    return dealt.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_row") + 1).cast("long").alias(out))


def after(order: Sequence[str], last: Sequence[object]) -> Column:
    """Rows behind ``last`` in the order of the columns. The first column is bounded by itself, so the condition reaches the scan."""
    behind = F.lit(False)
    for i, (name, value) in enumerate(zip(order, last, strict=True)):
        same = F.lit(True)
        for n, v in zip(order[:i], last[:i], strict=True):
            same = same & (F.col(n) == F.lit(v))
        behind = behind | (same & (F.col(name) > F.lit(value)))
    return (F.col(order[0]) >= F.lit(last[0])) & behind


def page_after(df: DataFrame, order: Sequence[str], last: Sequence[object] | None, limit: int = 100) -> DataFrame:
    """The next ``limit`` rows behind the key ``last`` (none: the first page) by columns without nulls. However deep a page lies, only rows
    behind its key are looked at, and no row before it is sorted."""
    rows = df if last is None else df.where(after(order, last))
    return rows.orderBy(*order).limit(limit)
