"""Near-duplicate vectors by iterative quantisation.

A rotation is learnt that turns centred unit vectors so that their signs make balanced binary codes close to them; several
such rotations, from different starts, give a long code. The code is cut into substrings, each the key of one Hamming table.
Vectors that meet in a table, whose sketches (the code's first bits) are near enough, are compared by cosine on the original
vectors in double precision.

How many bits a table has follows from the rows of the largest label, so that a table's buckets stay small however many rows there
are. How many tables there are follows from the chance that a bit of two vectors just at the threshold differs. That chance depends on
the data: centring widens the angle between vectors that all have a common direction. With a mean of squared length m, unit vectors at
cosine c are at cosine (c - m) / (1 - m) on average once it is taken off, and a bit differs with a chance of p = arccos of that / pi: 0.12 at
0.93 if there is no common direction, 0.28 if m = 0.8. The tables are so many that such a pair misses all of them with a chance of MISS.
If that takes more than MAX_TABLES, codes cannot tell the near from the rest, and all vectors of a label are compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .components import components

COSINE = 0.93
#: Vectors from which the rotations are learnt: those first by the hash of their id.
FIT_VECTORS = 8192
#: Bits of the sketch; least and greatest bits of a table.
SKETCH_BITS, LEAST_BITS, MOST_BITS = 192, 6, 24
#: Chance that all tables miss a pair at the threshold, and the most tables.
MISS, MAX_TABLES = 0.0005, 160
ROUNDS = 40
#: Vectors of a block, on average, where all are compared.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components there and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)


def unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision, padded with zeros to one dimension."""
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(column), dimension))
    x[np.arange(dimension) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of d x bits): blocks of d bits, each a rotation learnt from a random start."""
    mean, d = x.mean(axis=0), x.shape[1]
    v = x - mean
    _, axes = np.linalg.eigh(v.T @ v)
    v = v @ axes
    rng, found = np.random.default_rng(seed), []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ b)  # the rotation that brings v closest to its codes
            r = left @ right
        found.append(axes @ r)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def plan(x: np.ndarray, largest: int, cosine: float) -> tuple[int, int, int]:
    """(bits of a table, tables, greatest distance of sketches) for unit vectors like x, of which the largest label has so many.
    No tables: codes cannot tell."""
    common = float((x.mean(axis=0) ** 2).sum())
    p = math.acos(max(-1.0, (cosine - common) / (1 - common))) / math.pi if common < cosine else 1.0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, largest)))))
    hit = (1 - p) ** bits
    tables = math.ceil(math.log(MISS) / math.log1p(-hit)) if 0 < hit < 1 else 0
    # bits of one pair are not independent: ten deviations leave room
    radius = p * SKETCH_BITS + 10 * math.sqrt(SKETCH_BITS * p * (1 - p))
    return bits, tables if tables <= MAX_TABLES else 0, min(SKETCH_BITS, math.ceil(radius))


def _codes(heads: DataFrame, dimension: int, mean: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> DataFrame:
    """heads(head, label, embedding): head, label, dim, sketch as longs and keys array<long>, one of each table."""
    words = SKETCH_BITS // 64
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            signs = (unit_rows(batch.column(2), dimension) - mean) @ turn >= 0
            sketch = np.packbits(signs[:, :SKETCH_BITS], axis=1, bitorder="little").view("<i8")
            keys = (signs[:, : bits * tables].reshape(-1, tables, bits) @ weights).astype(np.int64) | np.arange(tables, dtype=np.int64) << bits
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(keys) + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *[pa.array(sketch[:, j]) for j in range(words)], lists]
            yield pa.RecordBatch.from_arrays(columns, names=["head", "label", "dim", *[f"w{j}" for j in range(words)], "keys"])

    label = heads.schema["label"].dataType.simpleString()
    return heads.select("head", "label", "embedding").mapInArrow(run, f"head long, label {label}, dim int, " + ", ".join(f"w{j} long" for j in range(words)) + ", keys array<long>")


def _pairs(codes: DataFrame, radius: int) -> DataFrame:
    """a, b: heads that meet in a table and whose sketches differ in no more than ``radius`` bits."""
    words = [c for c in codes.columns if c[0] == "w"]
    placed = codes.select("head", "label", "dim", *words, F.explode("keys").alias("key"))
    side = lambda s: placed.select("label", "dim", "key", F.col("head").alias(s), *[F.col(w).alias(f"{s}_{w}") for w in words])
    differ = [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words]
    return side("a").join(side("b"), ["label", "dim", "key"]).where((F.col("a") < F.col("b")) & (sum(differ[1:], differ[0]) <= radius)).select("a", "b").distinct()


def _verify(pairs: DataFrame, heads: DataFrame, dimension: int, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = unit_rows(batch.column(2), dimension), unit_rows(batch.column(3), dimension)
            keep = pa.array(np.einsum("ij,ij->i", x, y) >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    of = lambda s: heads.select(F.col("head").alias(s), F.col("embedding").alias(f"v{s}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _all_links(heads: DataFrame, sizes: DataFrame, dimension: int, cosine: float) -> DataFrame:
    """The links of all vectors of one label and length, each pair of blocks in a task of its own."""
    rows = heads.select("head", "label", F.size("embedding").alias("dim"), "embedding").join(sizes.select("label", "dim", F.ceil(F.col("n") / BLOCK).alias("blocks")), ["label", "dim"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("head"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "head", "embedding")

    def cell(table: pa.Table) -> pa.Table:
        own, head = table["own"].to_numpy(), table["head"].to_numpy()
        x = unit_rows(table["embedding"].combine_chunks(), dimension)
        left = np.flatnonzero(own == table["i"][0].as_py())
        right = np.flatnonzero(own == table["j"][0].as_py())
        found = []
        for a in range(0, len(left), 512):
            some = left[a : a + 512]
            r, c = np.nonzero(x[some] @ x[right].T >= cosine - 1e-9)
            r, c = some[r], right[c]
            # row by row, as everywhere: no rounding of its own at the threshold
            ok = (np.einsum("ij,ij->i", x[r], x[c]) >= cosine) & ((own[r] != own[c]) | (head[r] < head[c]))
            found.append((head[r[ok]], head[c[ok]]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("label", "dim", "i", "j").applyInArrow(cell, "a long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links: other rows linked directly, that is with an equal, non-null label and a cosine of ``cosine`` or more.
    component_id: least id reachable by links. Vectors of different length link with nothing of each other; those that
    take no part (see ``usable``) or have no label have no links. Rows that share an id are rows of their own: each has its own
    links, which count the others. Rows without id are left out. An empty table gives no rows. Rows of equal vector and label are
    compared as one and counted as many.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    able = F.col("label").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False))
    good = rows.where(able)
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    heads = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    heads = save(heads.withColumn("head", F.monotonically_increasing_id()), "itq-heads")
    sizes = heads.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dimension, largest = sizes.agg(F.max("dim"), F.max("n")).first()
    if dimension is None:
        return alone.withColumn("kept", F.lit(True))
    sample = heads.orderBy(F.xxhash64("least", "head"), "head").limit(FIT_VECTORS).select("embedding").toArrow()["embedding"].combine_chunks()
    x = unit_rows(sample, dimension)
    bits, tables, radius = plan(x, largest, cosine)
    if tables:
        mean, turn = learn(x, max(SKETCH_BITS, bits * tables))
        codes = save(_codes(heads, dimension, mean, turn, bits, tables), "itq-codes")
        pairs = save(_pairs(codes, radius), "itq-pairs")
        links = save(_verify(pairs, heads, dimension, cosine), "itq-links")
        discard(codes, pairs)
    else:
        links = save(_all_links(heads, sizes, dimension, cosine), "itq-links")

    copies = heads.select(F.col("head").alias("other"), "copies")
    both = links.select(F.col("a").alias("head"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("head"), F.col("a").alias("other")))
    counts = both.join(copies, "other").groupBy("head").agg(F.sum("copies").alias("others"))
    classes = components(links).select(F.col("node").alias("head"), "component")
    told = heads.join(counts, "head", "left").join(classes, "head", "left").withColumn("component", F.coalesce("component", "head"))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = good.join(told, ["label", "embedding"]).select("vec_id", F.col("n_links").cast("long"), "component_id")
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
