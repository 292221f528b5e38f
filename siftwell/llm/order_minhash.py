"""Near-duplicate documents by Order MinHash.

A text is a sequence of shingles of five words, each labelled with how often it has occurred before. A sketch function
takes the few labelled shingles with the least hashes and keeps them in the order of the text, so two texts agree on it
when they share those shingles in that order. Texts that agree on a function are candidates. A banded alignment of the
two shingle sequences then decides: with M shingles aligned in order, texts of n and m shingles are linked if
M / (n + m - M) >= 0.8. Aligning so many leaves at most (n + m) / 9 shingles out, which bounds the band exactly.

Equal texts are one text here, so copies are never compared. One link settles where a text belongs, so texts that share a
sketch are not all compared with each other. Of the leaders of its buckets, every text is first compared with the one it meets
most often, which settles groups of near copies with one comparison for each member. Texts that still stand in other groups
than texts of their buckets are then compared with a few more leaders of each bucket, and only what is left after that is
compared in pairs; none are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, save, slices, text_buffer
from .components import components
from .hashing import hash_words, mix
from .marks import bitmap, marked

WORDS = 5
SIMILARITY = 0.8
#: (sketch functions, shingles in each, least and greatest number of shingles of a text). A pair at similarity 0.8 has
#: at most 1.25 times as many on one side, so it always meets in one family; it is missed by all its functions with a chance below 0.005.
FAMILIES = ((50, 8, 24, None), (20, 3, 1, 40))
#: Rounds in which texts meet further leaders of their buckets, and leaders that a text meets in each.
ROUNDS, LEADERS = 1, 2
#: Bits of a text's map of shingles.
MAP_BITS = 1024


def shingles(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the labelled shingles of one text's bytes, in order. A text of fewer words has one shingle, of all its
    words; one without words has none. The first occurrence of a shingle has label 0."""
    return label(_shingle(hash_words(data)[0], words))


def _shingle(word: np.ndarray, words: int) -> np.ndarray:
    if not len(word):
        return word
    size = max(1, len(word) - words + 1)
    out = np.full(size, len(word) if len(word) < words else 0, dtype=np.uint64)
    for j in range(min(words, len(word))):
        out = mix(out ^ word[j : j + size])
    return out


def label(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    order = np.argsort(x, kind="stable")
    s = x[order]
    if not (s[1:] == s[:-1]).any():
        return x
    first = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.arange(len(s))
    times = at - np.maximum.accumulate(np.where(first, at, 0))
    out = x.copy()
    again = times > 0
    out[order[again]] = mix(s[again] ^ mix(times[again].astype(np.uint64)))
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """A key for each sketch function that applies to a text of so many labelled shingles."""
    keys = []
    for number, (functions, size, least, most) in enumerate(FAMILIES):
        if len(x) < least or (most is not None and len(x) > most):
            continue
        seeds = mix(np.arange(functions, dtype=np.uint64) + np.uint64(1000 * (number + 1)))
        take = min(size, len(x))
        step = max(1, (1 << 18) // len(x))
        for a in range(0, functions, step):
            h = (x[None, :] ^ seeds[a : a + step, None]) * (seeds[a : a + step, None] | np.uint64(1))
            h ^= h >> np.uint64(29)
            at = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take] if take < len(x) else np.broadcast_to(np.arange(take), (len(h), take)), axis=1)
            key = seeds[a : a + step].copy()
            for j in range(take):
                key = mix(key ^ x[at[:, j]])
            keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def aligned(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> float:
    """M / (n + m - M) by banded alignment, or 0 where it cannot reach ``similarity``. Labelled shingles are distinct
    within a text, so the alignment is the longest increasing run of their places, kept within the band."""
    n, m = len(x), len(y)
    need = similarity * (n + m) / (1 + similarity)
    if not n or not m or min(n, m) < need - 1e-9:
        return 0.0
    order = np.argsort(y)
    found = np.searchsorted(y[order], x)
    found[found == m] = 0
    place = order[found]
    common = y[place] == x
    places, own = place[common], np.flatnonzero(common)
    band = n + m - 2 * need
    places = places[np.abs(places - own) <= band + 1e-9]
    if len(places) < need - 1e-9:
        return 0.0
    if (np.diff(places) > 0).all():
        length = len(places)
    else:
        from bisect import bisect_left

        tails: list[int] = []
        for p in places.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        length = len(tails)
    return length / (n + m - length)


def shingle_map(x: np.ndarray) -> np.ndarray:
    """MAP_BITS bits as longs, in which that of each labelled shingle is set."""
    bits = np.zeros(MAP_BITS, dtype=bool)
    bits[(x & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def _sketches(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text): doc_id, digest, n (labelled shingles), keys array<long> and map array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffer(batch.column(2))
            counts, keys, maps = [], [], []
            for a, b in chunks(batch, offsets):
                part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                # rows are set apart by a space, so that no word runs over from one text into the next
                part = np.insert(part, cut[1:-1], 32)
                cut = cut + np.arange(len(cut))
                word, start = hash_words(part)
                at = np.searchsorted(start, cut)
                for i in range(b - a):
                    x = label(_shingle(word[at[i] : at[i + 1]], WORDS))
                    counts.append(len(x))
                    keys.append(sketch(x).astype(np.int64))
                    maps.append(shingle_map(x))
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (keys, maps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), *lists], names=["doc_id", "digest", "n", "keys", "map"])

    return rows.select("doc_id", digest().alias("digest"), "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, n int, keys array<long>, map array<long>")


def digest():
    """16 bytes by which a text is known."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _texts(rows: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """digest and shingles (binary) of the texts in pairs(a, b), each made once; other texts do not leave their task."""
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    bits = bitmap(wanted.join(heads, "digest").select(F.xxhash64("rep").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(marked(batch.column(1).to_numpy().view(np.uint64), bits)))
            if batch.num_rows:
                yield batch.select([0])

    found = rows.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "text string").select(digest().alias("digest"), "text")
    once = found.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = text_buffer(batch.column(1))
            made = [shingles(data[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["digest", "shingles"])

    return once.mapInArrow(cut, "digest binary, shingles binary")


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs(a, b) of texts(digest, shingles): those linked, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            out = [aligned(x, y, similarity) for x, y in zip(left, right, strict=True)]
            score = np.array(out, dtype=np.float64)
            keep = pa.array(score >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(score).filter(keep)], names=["a", "b", "similarity"])

    texts = save(texts, "omh-shingles", dictionary=False)
    left, right = texts.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, similarity double")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _apart(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """key, text, n, group: texts of the buckets that hold texts of several groups, as far as ``links`` tell."""
    settled = components(links.select("a", "b"))
    at = crowded.join(settled.withColumnRenamed("node", "text"), "text", "left").select("key", "text", "n", F.coalesce("component", "text").alias("group"))
    mixed = at.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")
    apart = save(at.join(mixed, "key"), "omh-apart")
    discard(settled)
    return apart


def _further(apart: DataFrame, turn: int, similarity: float) -> DataFrame:
    """a, b: texts of ``apart`` with leaders of other groups. A bucket's leader is its text of least seeded hash, so that few texts lead many
    buckets; of the leaders that a text meets, it is compared with the LEADERS that it meets in most buckets."""
    leader = F.min(F.struct(F.xxhash64("text", F.lit(turn)).alias("order"), "text", "n", "group")).alias("of")
    leads = apart.groupBy("key").agg(leader).select("key", F.col("of.text").alias("leader"), F.col("of.n").alias("m"), F.col("of.group").alias("other"))
    # n / m >= similarity is necessary; 1e-9 for rounding
    near = F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - F.lit(1e-9)
    met = apart.join(leads, "key").where((F.col("group") != F.col("other")) & near).groupBy("text", "leader").agg(F.count(F.lit(1)).alias("times"))
    best = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("times"), "leader"))  # a text has as many rows as buckets at most
    return met.withColumn("place", best).where(F.col("place") <= LEADERS).select(*_ordered("leader", "text")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, class_id, digest, class_digest for each row of ``docs``; links a, b, similarity between different texts, which span the classes).

    rep: least id with the same text; class_id: least id of the class. Words are compared in lower case. Null and
    empty texts, and those of white space only, link with nothing but equal texts; a null equals an empty text. Rows
    without id are left out. Rows that share an id are classed by their own texts, which digest and class_digest name.
    a and b are the least ids of two texts. An empty table gives empty tables.
    """
    rows = _rows(docs, id_col, text_col)
    sketched = save(_sketches(rows), "omh-sketches")
    heads = save(sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("map").alias("map")), "omh-heads")
    reps = heads.select("digest", "rep")
    bands = heads.select(F.col("digest").alias("text"), "n", F.explode("keys").alias("key")).distinct()
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = save(bands.join(sizes, "key"), "omh-crowded")

    # A bucket's leader is the text that meets most others in all its buckets: of a group of near copies, the one they were
    # made from. Every other text is compared with the leader it meets in most buckets.
    rank = crowded.groupBy("text").agg(F.struct(-F.sum("size"), F.col("text")).alias("rank"))
    leaders = crowded.select("key", "text").join(rank, "text").groupBy("key").agg(F.min_by("text", "rank").alias("leader"))
    met = crowded.join(leaders, "key").where("text <> leader").groupBy("leader", "text").agg(F.count(F.lit(1)).alias("times"))
    first = save(met.groupBy("text").agg(F.min_by("leader", F.struct(-F.col("times"), "leader")).alias("leader")).select(*_ordered("leader", "text")).distinct(), "omh-first")
    links = save(_verify(first, _texts(rows, reps, first), similarity), "omh-links1")

    # texts of different groups that share a bucket: each with the further leaders that it meets most often
    compared = [first]
    for turn in range(ROUNDS):
        apart = _apart(crowded, links)
        pairs = save(_further(apart, turn, similarity).join(reduce(DataFrame.unionByName, compared), ["a", "b"], "left_anti"), "omh-further")
        links = links.unionByName(save(_verify(pairs, _texts(rows, reps, pairs), similarity), "omh-links2"))
        compared.append(pairs)
        discard(apart)

    # and what is left in pairs: each once, in the first bucket that it shares, and only if its maps leave room for the similarity
    apart = _apart(crowded, links)
    known = apart.join(heads.select(F.col("digest").alias("text"), "keys", "map"), "text")
    other = known.select("key", *[F.col(c).alias(f"other_{c}") for c in ("text", "n", "group", "keys", "map")])
    total = lambda longs: F.aggregate(longs, F.lit(0), lambda n, x: n + F.bit_count(x))
    # shingles of one text that fall on one bit may all be shared
    shared = total(F.zip_with("map", "other_map", lambda x, y: x.bitwiseAND(y))) + F.least(F.col("n") - total("map"), F.col("other_n") - total("other_map"))
    may = shared >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("other_n")) - F.lit(1e-9)
    sized = F.least("n", "other_n") >= F.greatest("n", "other_n") * F.lit(similarity) - F.lit(1e-9)
    once = F.col("key") == F.array_min(F.array_intersect("keys", "other_keys"))
    third = known.join(other, "key").where((F.col("text") < F.col("other_text")) & (F.col("group") != F.col("other_group")) & sized & may & once).select(*_ordered("other_text", "text")).distinct()
    third = save(third.join(reduce(DataFrame.unionByName, compared), ["a", "b"], "left_anti"), "omh-third")
    links = links.unionByName(save(_verify(third, _texts(rows, reps, third), similarity), "omh-links3"))
    discard(crowded, apart, third, *compared)

    classes = components(links.select("a", "b"))
    of_text = reps.join(classes.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("class_digest"))
    least = of_text.groupBy("class_digest").agg(F.min("rep").alias("class_id"))
    of_text = of_text.join(least, "class_digest").select("digest", "rep", "class_id", "class_digest")
    found = sketched.select("doc_id", "digest").join(of_text, "digest").select("doc_id", "rep", "class_id", "digest", "class_digest")
    named = lambda c: reps.select(F.col("digest").alias(c), F.col("rep").alias(f"{c}_id"))
    links = links.join(named("a"), "a").join(named("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")
    return found, links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``docs``: that with the least id, and the least digest of its text if rows share that id; of rows that
    agree in both, any one. Rows without id stay."""
    found, _ = near_duplicates(docs, id_col, text_col, similarity)
    kept = found.groupBy("class_digest").agg(F.min(F.struct("doc_id", "digest")).alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.digest").alias("kept_digest"))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(id_col).alias("kept_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    at = ["kept_id", "kept_digest"]
    one = named.where(F.col("kept_id").isNotNull()).withColumn("kept_digest", digest()).drop("text").join(kept, at, "left_semi").dropDuplicates(at)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return one.select(*back).unionByName(docs.where(F.col(id_col).isNull()))
