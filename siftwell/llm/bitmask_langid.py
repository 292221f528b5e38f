"""Language identification by bit-sliced Bloom filters over n-grams.

One array of bitmasks holds a Bloom filter for each language: bit l of a slot is that slot of language l's filter. The
AND of an n-gram's slots is then the set of all languages that contain it, in one lookup for all of them. A text's
n-grams are counted for each language (popcount of its bit), the count that false positives alone would give is taken
off, and the language with the largest share decides.

The filters hold the most frequent n-grams of a bounded sample of labelled texts; n-grams are of the bytes of the text in
lower case, where ASCII characters other than letters count as spaces. Prediction sees the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, slices, text_buffer
from .hashing import mix, runs

#: Labelled rows of each language from whose texts the filters are learnt: those first by the hash of their id.
FIT_TEXTS = 1000
#: n-grams of each language, by length in bytes.
GRAMS = {3: 3000, 4: 6000}
SLOTS = 1 << 18
HASHES = 3
MAX_LANGUAGES = 64
#: A language shows in a text where false positives give as many different n-grams with a chance of exp(-SHOWS) at most.
SHOWS = 4

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of each text (not across texts, none with two spaces side by side), and the text of each."""
    folded = _CLASS[data].astype(np.uint64)
    size = len(folded) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.full(size, n, dtype=np.uint64)
    blank = folded == 32
    good = np.ones(size, dtype=bool)
    for j in range(n):
        packed = packed << np.uint64(8) | folded[j : j + size]
        if j:
            good &= ~(blank[j - 1 : j - 1 + size] & blank[j : j + size])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:size]
    good &= np.arange(size) + n <= offsets[1:][row]
    return packed[good], row[good]


def slots(packed: np.ndarray) -> list[np.ndarray]:
    h, bits = mix(packed), np.uint64(SLOTS.bit_length() - 1)
    return [((h >> (np.uint64(j) * bits)) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]  # the most frequent in the sample first
    masks: np.ndarray
    false_rate: np.ndarray  # chance that an n-gram in none of a language's texts passes its filter

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, n-grams of each text and language, corrected for false positives)."""
        rows = len(offsets) - 1
        total, found = np.zeros(rows), np.zeros((rows, len(self.languages)))
        for n in GRAMS:
            packed, row = grams(data, offsets, n)
            if not len(packed):
                continue
            at = slots(packed)
            mask = self.masks[at[0]]
            for x in at[1:]:
                mask = mask & self.masks[x]
            starts = runs(row)
            total[row[starts]] += np.diff(np.append(starts, len(row)))
            for i in range(len(self.languages)):
                found[row[starts], i] += np.add.reduceat((mask >> np.uint64(i) & np.uint64(1)).astype(np.int64), starts)
        return total, np.maximum(0, (found - total[:, None] * self.false_rate) / (1 - self.false_rate))

    def shows(self, data: np.ndarray) -> bool:
        """Whether more different n-grams of one text pass a filter than chance gives (Chernoff bound of the binomial tail)."""
        packed = np.unique(np.concatenate([grams(data, np.array([0, len(data)]), n)[0] for n in GRAMS]))
        mask = np.bitwise_and.reduce([self.masks[x] for x in slots(packed)])
        found = np.array([np.count_nonzero(mask >> np.uint64(i) & np.uint64(1)) for i in range(len(self.languages))])
        chance = np.maximum(len(packed) * self.false_rate, 1e-300)
        return bool(((found > chance) & (found * np.log(np.maximum(found, 1) / chance) - found + chance >= SHOWS)).any())


def build(languages: list[str], members: list[np.ndarray]) -> Filters:
    masks = np.zeros(SLOTS, dtype=np.uint64)
    for i, packed in enumerate(members):
        for at in slots(packed):
            masks[at] |= np.uint64(1 << i)
    fill = np.array([(masks >> np.uint64(i) & np.uint64(1)).mean() for i in range(len(languages))])
    return Filters(tuple(languages), masks, np.minimum(0.99, fill**HASHES))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS) -> Filters:
    """Learn the filters from rows where ``train`` holds, with text and language, at most ``fit_texts`` of each language.

    More than 64 languages are an error. No such row: no language.
    """
    # ids only, ranked within parts of a language and then within it, so that no task orders a whole language
    by_hash = [F.xxhash64("id"), F.col("id")]
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.pmod(F.hash(F.col(id_col)), F.lit(64)).alias("part"))
    for parts in (["lang", "part"], ["lang"]):
        labelled = labelled.withColumn("rn", F.row_number().over(Window.partitionBy(*parts).orderBy(*by_hash))).where(F.col("rn") <= fit_texts)
    # at most MAX_LANGUAGES x fit_texts ids are of use, more languages are refused below
    chosen = F.broadcast(labelled.select("id", "lang").limit((MAX_LANGUAGES + 1) * fit_texts))
    texts = docs.where(train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    sample = texts.join(chosen, ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, (data, offsets) = np.array(batch.column(0).to_pylist()), text_buffer(batch.column(1))
            for a, b in chunks(batch, offsets):
                part = data[offsets[a] : offsets[b]]
                for name in np.unique(names[a:b]):
                    for n in GRAMS:
                        packed, row = grams(part, offsets[a : b + 1] - offsets[a], n)
                        values, times = np.unique(packed[(names[a:b] == name)[row]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array([n] * len(values), pa.int32()), pa.array(values.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "n", "gram", "times"])

    order = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")
    most = F.lit(0)
    for n, k in GRAMS.items():
        most = F.when(F.col("n") == n, k).otherwise(most)
    top = sample.mapInArrow(count, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    # bounded: at most 64 languages, sum(GRAMS) n-grams each
    kept = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.sum("times").alias("times")).orderBy(F.desc("times"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(kept) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return build([r["lang"] for r in kept], [np.array(r["grams"], dtype=np.int64).astype(np.uint64) for r in kept])


def identify(docs: DataFrame, filters: Filters | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, shown: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score (or ``keep``, lang_pred and score) of each row of ``docs``.

    A letter is a character of Unicode's category L. Columns of ``keep`` called lang_pred, score or shown give way to the operator's own.

    Without ``filters`` they are learnt from the rows that are not held out. ``und`` with score 0 for a null text, one
    without a letter, and where no language was learnt. Otherwise a learnt language: the largest corrected count, ties
    to the one most frequent in training; score = that count by the sum of the two largest, 0 if there is no evidence. With ``shown`` also the column shown: whether
    any learnt language is in evidence, beyond what false positives give (see SHOWS).
    """
    if filters is None:
        filters = fit(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col)
    if keep is None:
        first = [F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out")]
    else:
        first = [F.col(c) for c in keep if c not in ("lang_pred", "score", "shown")]
    outer = docs.select(*first).schema.fields
    # named by place here, as columns to be kept may be called anything
    inner = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(first)], F.col(text_col).alias("text_in"), F.lower(text_col).alias("text_low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, (data, offsets) = batch.column(batch.num_columns - 2), text_buffer(batch.column(batch.num_columns - 1))
            lang, score, shows = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for a, b in chunks(batch, offsets):
                if not filters.languages:
                    break
                total, found = filters.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best = found.argmax(axis=1)
                two = np.sort(found, axis=1)[:, -2:].sum(axis=1)
                top = found[np.arange(b - a), best]
                for i in range(a, b):
                    text = texts[i].as_py()
                    if text is not None and _LETTER.search(text):
                        lang[i] = filters.languages[best[i - a]]
                        score[i] = top[i - a] / two[i - a] if two[i - a] > 0 else 0.0
                        # half of all n-grams is no chance; only texts in doubt are counted again
                        shows[i] = shown and (2 * top[i - a] > total[i - a] or filters.shows(data[offsets[i] : offsets[i + 1]]))
            columns = [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())] + [pa.array(shows)] * shown
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[f.name for f in outer] + ["lang_pred", "score"] + ["shown"] * shown)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outer) + ", lang_pred string, score double" + ", shown boolean" * shown
    return inner.mapInArrow(run, schema)
