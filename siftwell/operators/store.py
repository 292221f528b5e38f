"""The relational store as tables: inserts of what is new, updates by key, filters, pages and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def insert_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored; the first of equal keys by ``order``. To be appended."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = incoming.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.join(stored.select(*keys), list(keys), "left_anti")


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; none if there is no such key. The condition reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def keyed_update(stored: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``stored`` with the given columns replaced where an update has a value for them. One update for a key."""
    new = updates.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns])
    out = stored.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def increment(stored: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """One more for the rows whose key is in ``ids``."""
    hit = ids.select(key).distinct().withColumn("hit", F.lit(1))
    return stored.join(hit, key, "left").withColumn(column, F.col(column) + F.coalesce("hit", F.lit(0))).select(*stored.columns)


def cascade_delete(children: DataFrame, deleted: DataFrame, parent_key: str, deleted_key: str) -> DataFrame:
    return children.join(deleted.select(F.col(deleted_key).alias(parent_key)), parent_key, "left_anti").select(*children.columns)


def page_of(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a total order; ``order`` should end with a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per(df: DataFrame, key: str, order: Sequence[Column], most: int = 500) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def batch_ids(df: DataFrame, order: str | Sequence[str], size: int = 100) -> DataFrame:
    """Adds batch_id from 1: so many rows each, in the order of one or more columns of any kind that sorts."""
    return numbered(df, [order] if isinstance(order, str) else order, "batch_id").withColumn("batch_id", F.ceil(F.col("batch_id") / size).cast("long"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def jobs_per_minute(processed: Column, seconds: Column) -> Column:
    return F.round(processed / F.greatest(seconds / 60.0, F.lit(1.0)), 2)


def nest(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], out: str, order: Sequence[Column]) -> DataFrame:
    """parents plus an array of their children's structs in order; an empty one for those without children."""
    keyed = children.select(key, F.struct(*order, F.struct(*fields).alias("row")).alias("item"))
    lists = keyed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["row"]).alias(out))
    empty = F.array().cast(lists.schema[out].dataType)
    return parents.join(lists, key, "left").withColumn(out, F.coalesce(out, empty))
