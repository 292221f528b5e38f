"""Connected components of a graph in Spark, without bringing links to the driver."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

#: Rows of a file of links, about. No more links than that are one task's work; more are dealt out.
FILE_ROWS = 100_000


def _both(edges: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """Two rows (u, v) of each row: its columns x and its columns y."""
    pairs = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (x, y)])
    return edges.select(F.explode(pairs).alias("pair")).select("pair.u", "pair.v")


def _least(rows: DataFrame, small: bool) -> DataFrame:
    """rows(u, v) with m, the least v of each u."""
    if small:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b): node and component (its least node), for every node that has a link.

    Alternating large-star and small-star: each node sends its larger, then its smaller neighbours to the least node it
    knows. Rounds grow with the logarithm of the longest path, rows never exceed the links. A node with very many
    links is aggregated with partial minima and joined, never collected.
    """
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before, rows = None, edges.count()
    # links never become more; those of a small graph are read by one task, in which Spark shuffles nothing
    small = rows <= FILE_ROWS
    read = lambda df: df.coalesce(1) if small else df
    for _ in range(most_rounds):
        both = _least(_both(read(edges), ["u", "v"], ["v", "u"]), small).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = _both(_least(large, small), ["v", "m"], ["u", "m"]).where("u <> v").distinct()
        # no more links than there were: a small graph is not written as a file for each task of a shuffle
        edges, last = save(step.coalesce(ceil((rows + 1) / FILE_ROWS)), "cc"), edges
        discard(last)
        # at the end every node hangs on its root alone: the same number of rows and the same sums twice running
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    roots = read(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    found.saved_at = edges.saved_at  # for ``discard``
    return found
