"""Sharding by a hierarchical weighted hash tree.

A document descends from region to rack to shard. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed
from the document's id and the child's name, and the smallest draw wins. A child's draw depends on nothing but the id,
its name and its own weight, so a change of weight moves documents only into or out of the subtree that changed.

Law ``key``: the id and the topology decide. A shard that is added as a region of its own changes no other weight, so
documents move into it alone. Rows without id have a key made of their text, so they are spread like others.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of one shard that are numbered apart, so that no task orders a whole shard.
SLOT_BUCKETS = 1024


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """A cluster built with ``base`` shards and grown since. The first ``base`` fill regions of ``racks`` x ``per_rack`` shards of
    weight 1, in the order of the shard number; each shard added after is a region of its own. So one more shard, from any
    count on, changes the weight of no subtree that was there, and rows move into it only."""
    built = [Leaf(f"region{s // (racks * per_rack)}", f"rack{s // per_rack}", s) for s in range(min(shards, base))]
    return built + [Leaf(f"added{s}", f"added{s}", s) for s in range(base, shards)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("/"), name)), 12)
    return F.when(weight > 0, -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / weight).otherwise(F.lit(float("inf")))


def _level(df: DataFrame, out: str, parent: str | None, children: list[list[tuple[str, float]]]) -> DataFrame:
    """Adds ``out``: the index of the winning child among ``children[parent index]``; equal draws go to the first name."""
    most = max(map(len, children))
    padded = [c + [("", 0.0)] * (most - len(c)) for c in children]
    at = (lambda table, j: table[F.col(parent)][j]) if parent else (lambda table, j: table[0][j])
    names = F.array(*[F.array(*[F.lit(n) for n, _ in c]) for c in padded])
    weights = F.array(*[F.array(*[F.lit(float(w)) for _, w in c]) for c in padded])
    draws = F.array(*[F.struct(_draw(F.col("tree_key"), at(names, j), at(weights, j)).alias("d"), F.lit(j).alias("i")) for j in range(most)])
    return df.withColumn(out, F.array_min(draws)["i"])


def with_shard(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds ``out``: the shard number that a key descends to. Leaves of weight 0 get nothing; a subtree weighs what its leaves weigh."""
    tree: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in sorted(leaves):
        tree[leaf.region][leaf.rack].append(leaf)
    racks = [(region, rack) for region in tree for rack in tree[region]]
    first = {region: next(i for i, (r, _) in enumerate(racks) if r == region) for region in tree}
    weigh = lambda found: sum(x.weight for x in found)
    df = df.withColumn("tree_key", key.cast("string"))
    df = _level(df, "tree_region", None, [[(r, sum(map(weigh, tree[r].values()))) for r in tree]])
    df = _level(df, "tree_rack", "tree_region", [[(f"{r}/{k}", weigh(tree[r][k])) for k in tree[r]] for r in tree])
    df = df.withColumn("tree_rack", F.array(*[F.lit(first[r]) for r in tree])[F.col("tree_region")] + F.col("tree_rack"))
    df = _level(df, "tree_shard", "tree_rack", [[(f"{r}/{k}/shard{x.shard}", x.weight) for x in tree[r][k]] for r, k in racks])
    most = max(len(tree[r][k]) for r, k in racks)
    numbers = F.array(*[F.array(*[F.lit(x.shard) for x in tree[r][k]] + [F.lit(-1)] * (most - len(tree[r][k]))) for r, k in racks])
    return df.withColumn(out, numbers[F.col("tree_rack")][F.col("tree_shard")].cast("int")).drop("tree_key", "tree_region", "tree_rack", "tree_shard")


def assign_shards(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot and, with ``grown``, grown_shard.

    size: UTF-8 bytes plus 1 (a null text has none, so 1); text_crc32 of a null text is that of the empty text. slot: gapless from 0 in each
    shard, in the order of (bucket of the id, id, checksum, size); equal rows take neighbouring slots. An empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null/"), F.md5(text.cast("binary"))))
    bucket = F.pmod(F.xxhash64("key"), F.lit(SLOT_BUCKETS)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ).withColumn("bucket", bucket)
    rows = with_shard(rows, F.col("key"), leaves, "shard")
    rows = with_shard(rows, F.col("key"), grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    runs = with_shard(docs.select(key.alias("key")), F.col("key"), leaves, "shard").groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    # starts has at most len(leaves) x SLOT_BUCKETS rows, whatever the input
    return (
        rows.withColumn("r", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard")
    )
