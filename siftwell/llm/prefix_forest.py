"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a long string of signs of random projections and keeps the strings in a sorted array, in which
all strings with a given prefix stand side by side. A query descends in every tree to its longest prefix that some string
shares, and then ascends in all trees together, one bit at a time, each step adding the strings that share the shorter
prefix. It stops when a vector at least as near as the worst of the k best found would have been met so far with a chance of
``1 - MISS`` at least: such a vector shares a bit with the query with a chance p of its angle, so it shares b leading bits in none
of L trees with a chance of (1 - p ** b) ** L. The stop depends on the data only through the scores, and is the same rule at any size.

For inner products of vectors that are not of unit length, vectors are hashed with one more component that brings all of
a block to the same length, under which the order by angle is the order by inner product.

Rows are dealt into blocks of bounded size by a hash of their id; a block holds its own trees and answers every query of every
block of queries, and the best of all blocks are the answer. So no group, however many vectors are alike, is ever in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .itq_neardup import usable

TREES = 40
BITS = 32
MISS = 0.03
#: Vectors of a block of rows, and queries of a block of queries, on average.
BLOCK, QUERIES = 8192, 1024


class Forest:
    """Sorted arrays of the hash strings of some vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 5):
        self.x = x
        self.most = np.linalg.norm(x, axis=1).max()
        rest = np.sqrt(np.maximum(0.0, self.most**2 - (x * x).sum(axis=1)))
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits))
        self.trees, self.bits = trees, bits
        codes = self._hash(np.column_stack((x, rest)))
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=0)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        signs = (x @ self.planes >= 0).reshape(len(x), self.trees, self.bits)
        return signs.astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, miss: float = MISS) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the best found for each query, k and all that tie with the last; own: place that is the query itself, or -1."""
        strings = self._hash(np.column_stack((queries, np.zeros(len(queries)))))
        # low[b], high[b]: where the strings that share b leading bits begin and end, for all queries and trees
        low, high = (np.zeros((self.bits + 1, len(queries), self.trees), np.int64) for _ in range(2))
        for b in range(self.bits + 1):
            first = strings >> (self.bits - b) << (self.bits - b)
            for t in range(self.trees):
                low[b, :, t] = np.searchsorted(self.codes[:, t], first[:, t])
                high[b, :, t] = np.searchsorted(self.codes[:, t], first[:, t] + (1 << (self.bits - b)))
        shared = (high - low).sum(axis=2)
        by_tree = np.ascontiguousarray(self.order.T)
        out = []
        for q, query in enumerate(queries):
            length = np.linalg.norm(query) * self.most
            met = np.zeros(len(self.x), dtype=bool)
            done = met.copy()
            if own[q] >= 0:
                done[own[q]] = True
            places, scores = np.zeros(0, np.int64), np.zeros(0)
            # the longest prefixes that give some candidates at all, then one bit less at a time
            for b in range(int(np.flatnonzero(shared[:, q] >= min(4 * k, shared[0, q]))[-1]), -1, -1):
                for ranked, a, z in zip(by_tree, low[b, q].tolist(), high[b, q].tolist(), strict=True):
                    met[ranked[a:z]] = True
                new = np.flatnonzero(met & ~done)
                if len(new):
                    done[new] = True
                    places, scores = np.append(places, new), np.append(scores, self.x[new] @ query)
                if len(places) >= k and b:
                    worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                    share = 1 - np.arccos(np.clip(worst / length, -1, 1)) / np.pi
                    if (1 - share**b) ** self.trees <= miss:
                        break
            if len(places) > k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                places = places[scores >= worst - 1e-9 * length]
            # row by row, so that equal vectors have equal scores
            out.append((places, (self.x[places] * query).sum(axis=1)))
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product in double precision): up to k rows for each query.

    Queries are the rows where ``is_query`` holds; every other row is a candidate, the query's own never. Ties go to the
    smaller id; repeated rows of one id count once. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do those whose length differs from the most frequent one's (the greatest, if several). No usable row: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v"))).dropDuplicates(["vec_id"])
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("queries")).orderBy(F.desc("n"), F.desc("d")).first()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if sizes is None or not sizes["queries"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"])
    blocks, groups = -(-sizes["n"] // BLOCK), -(-sizes["queries"] // QUERIES)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    # every block of rows meets every block of queries; a cell holds one of each
    data = rows.select(deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "v")
    asked = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(groups).alias("group"), "vec_id", "v")

    def cell(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        data = data.sort_values("vec_id", ignore_index=True)
        ids = data["vec_id"].to_numpy()
        place = {v: i for i, v in enumerate(ids)}
        forest = Forest(np.stack(data["v"].to_numpy()))
        found = forest.search(np.stack(queries["v"].to_numpy()), np.array([place.get(v, -1) for v in queries["vec_id"]]), k)
        out = []
        for query, (places, scores) in zip(queries["vec_id"], found, strict=True):
            best = np.lexsort((places, -scores))[:k]  # places are in the order of ids
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[places[best]], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    found = asked.groupBy("block", "group").cogroup(data.groupBy("block", "group")).applyInPandas(cell, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
