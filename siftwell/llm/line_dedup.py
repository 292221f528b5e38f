"""Line dedup by an exact set-similarity join.

A line is the set of its words. All words have one global order, rarest first; two sets of Jaccard similarity t or more
must share a word among the first few of both (prefix filter), can differ only so much in size (length filter), and the
places of the shared word bound what they can still share (positional filter). What passes is verified on the whole
sets. A line goes if an earlier line - in the order of (doc_id, line number) - is at least that similar to it, whether or
not that earlier line stays itself.

Frequencies of words come from all documents, in a table of COUNTERS counts, one for all words of a hash. Words are ordered
by their count, in steps of about an eighth, and then by hash. Any fixed order keeps the join exact, so words that share a count cost
at most speed; the table has one size however large the corpus. Equal sets are joined as one, at the place of the first of them.
Sets too small to be similar to any but an equal one (three words and fewer at 0.8) have no part in the join; their keys tell all.

One earlier match settles a line, so the join runs twice. First every set meets only a few leaders, the earliest of those that
share one of its rarest words: linear in the lines, and it settles nearly all members of large groups of near copies, most of them
by the one leader that they meet in most words. Then all sets meet all earlier ones that share a word of the prefix; a pair whose
later line is settled is not made. Each row of that join carries a 128-bit map of the words of its set, so most pairs that share
one rare word by chance fall away where they meet.

Sets are known by 64-bit keys and words by 40-bit hashes; "exact" is meant up to equal hashes of different words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, save, slices, text_buffer
from .hashing import hash_words, mix, runs
from .marks import bitmap, marked

SIMILARITY = 0.8
#: Counts of words by hash: 8 bytes each in a task of the survey, one in later tasks.
COUNTERS = 1 << 19
#: Counters of a row of the survey.
_WIDE = 16
#: Bits of a word's hash.
HASH_BITS = 40
#: The first round: of so many words of a set's prefix, leaders for each word, and the size ratio within which they are leaders.
LEAD_WORDS, LEADERS, LEAD_RATIO = 3, 2, 1.25
#: Parts of the words that the second round goes through one after the other, to use less disk at a time.
PARTS = 2
_U = np.uint64
_MASK = _U((1 << HASH_BITS) - 1)


class _Lines:
    """The lines of some texts that have a word, as sets: in the global order, or in that of the hash if there are no levels."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, levels: np.ndarray | None):
        cut = offsets[:-1] + np.arange(len(offsets) - 1)
        data = np.insert(data, offsets[1:-1], 10)  # texts are set apart by a line break
        line_start = np.append(0, np.flatnonzero(data == 10) + 1)
        word, start = hash_words(data)
        word >>= _U(64 - HASH_BITS)
        code = word if levels is None else order_code(word, levels)
        first = np.append(np.searchsorted(start, line_start), len(start))
        parts = []
        for a in range(0, len(line_start), 1 << 16):  # 16 bits of the line's number and 48 of the code, sorted as one
            z = min(a + (1 << 16), len(line_start))
            number = np.repeat(np.arange(z - a, dtype=_U), np.diff(first[a : z + 1]))
            both = np.sort(number << _U(48) | code[first[a] : first[z]])
            both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
            parts.append(((both >> _U(48)).astype(np.int64) + a, both & _U((1 << 48) - 1)))
        line, self.codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.at = runs(line)
        self.line = line[self.at]
        self.size = np.diff(np.append(self.at, len(line)))
        own = np.add.reduceat(mix(self.codes & _MASK), self.at) if len(self.at) else np.zeros(0, _U)
        self.key = mix(own ^ self.size.astype(_U))
        self.row = np.searchsorted(cut, line_start[self.line], side="right") - 1
        self.number = self.line - np.searchsorted(line_start, cut)[self.row]


def counter_of(word: np.ndarray) -> np.ndarray:
    return (word >> _U(HASH_BITS - COUNTERS.bit_length() + 1)).astype(np.int64)


def order_code(word: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """48 bits that sort rarest first: 8 of the level of the word's count, 40 of its hash."""
    return levels[counter_of(word)] << _U(HASH_BITS) | word


def pack(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(words: bytes) -> np.ndarray:
    out = np.zeros((len(words) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(words, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def prefix_length(n: np.ndarray | int, similarity: float = SIMILARITY):
    return n - np.ceil(similarity * n - 1e-9).astype(int) + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))


def _survey(texts: DataFrame) -> DataFrame:
    """texts(id, text): rows key, id, line of all lines (counts null), and rows of a task's counts: number of the run, counts array<long>."""
    id_type = texts.schema["id"].dataType.simpleString()
    names = ["key", "id", "line", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, arrow_type = np.zeros(COUNTERS, np.int64), None
        for batch in slices(batches):
            arrow_type = batch.column(0).type
            data, offsets = text_buffer(batch.column(1))
            for a, b in chunks(batch, offsets):
                lines = _Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None)
                counts += np.bincount(counter_of(lines.codes), minlength=COUNTERS)
                columns = [pa.array(lines.key.astype(np.int64)), batch.column(0).take(pa.array(a + lines.row)), pa.array(lines.number.astype(np.int32)), pa.nulls(len(lines.key), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        wide = counts.reshape(-1, _WIDE)
        used = np.flatnonzero(wide.any(axis=1))
        for a in range(0, len(used), 5000):
            at = used[a : a + 5000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, _WIDE * len(at) + 1, _WIDE, dtype=np.int32)), pa.array(wide[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), arrow_type), pa.nulls(len(at), pa.int32()), lists], names=names)

    return texts.mapInArrow(run, f"key long, id {id_type}, line int, counts array<long>")


def _levels(survey: DataFrame) -> np.ndarray:
    """The level of each counter. What comes to the driver has one size: COUNTERS small numbers."""
    level = lambda i: F.least(F.lit(255), F.floor(F.lit(6) * F.log2(F.sum(F.col("counts")[i]).cast("double") + 1))).cast("short").alias(f"v{i}")
    found = survey.where("counts is not null").groupBy("key").agg(*[level(i) for i in range(_WIDE)]).toArrow()
    levels = np.zeros((COUNTERS // _WIDE, _WIDE), np.uint8)
    for i in range(_WIDE):
        levels[found["key"].to_numpy(), i] = found[f"v{i}"].to_numpy()
    return levels.ravel()


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of so many items from each start, where each run begins among them)."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum()), before


def _map(words: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """For each run of words a map of 128 bits, in which the bit of each word's hash is set, as two longs."""
    if not len(starts):
        return [pa.array([], pa.int64())] * 2
    place = mix(words) & _U(127)
    bit = _U(1) << (place & _U(63))
    return [pa.array(np.bitwise_or.reduceat(np.where(place >> _U(6) == j, bit, _U(0)), starts).astype(np.int64)) for j in (0, 1)]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words of each run as 32 bits of their hashes. Words that agree in these cost the join a needless pair, and no more."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.uint32).view(np.int32)))


def _prefixes(texts: DataFrame, levels: np.ndarray, repeated: np.ndarray, similarity: float) -> DataFrame:
    """key, id, line, n, map0, map1, prefix, lead and single of each set that another can come near to, once for each chunk of texts
    that holds it. prefix: its rarest words; lead: those of them with the least hashes; single: it occurs nowhere else (``repeated``: the
    map of keys that may)."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = levels.astype(_U)
        for batch in slices(batches):
            data, offsets = text_buffer(batch.column(1))
            for a, b in chunks(batch, offsets):
                lines = _Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], full)
                # the nearest that another set can come to one of n words is n of n + 1
                able = np.flatnonzero(lines.size >= similarity * (lines.size + 1) - 1e-9)
                sizes, single = lines.size[able], ~marked(lines.key[able], repeated)
                place, before = _ragged(lines.at[able], prefix_length(sizes, similarity))
                words = lines.codes[place]
                whole, starts = _ragged(lines.at[able], sizes)
                owner = np.repeat(np.arange(len(able)), np.diff(np.append(before, len(words))))
                by_hash = np.lexsort((words & _MASK, owner))  # a word's hash is random, its level is not
                lead = by_hash[np.arange(len(words)) - before[owner] < LEAD_WORDS]
                columns = [
                    pa.array(lines.key[able].astype(np.int64)), batch.column(0).take(pa.array(a + lines.row[able])), pa.array(lines.number[able].astype(np.int32)), pa.array(sizes.astype(np.int32)),
                    *_map(lines.codes[whole], starts), _lists(words, before), _lists(words[lead], np.searchsorted(owner[lead], np.arange(len(able)))), pa.array(single),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "line", "n", "map0", "map1", "prefix", "lead", "single"])

    return texts.mapInArrow(run, f"key long, id {id_type}, line int, n int, map0 long, map1 long, prefix array<int>, lead array<int>, single boolean")


_SET = ["key", "id", "line", "n", "map0", "map1", "prefix", "lead"]


def _firsts(prefixes: DataFrame) -> DataFrame:
    """Sets that may occur more than once, each once, at its first place. id and line decide the minimum; the rest follows from the key."""
    return prefixes.where("not single").groupBy("key").agg(F.min(F.struct(*_SET[1:])).alias("x")).select("key", "x.*")


def _may_share(n: Column, m: Column, maps: list[tuple[Column, Column]], similarity: float) -> Column:
    """Whether sets of n and m words may be so similar by their maps: words of one set that fall on one bit may all be shared."""
    need = F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(1e-9)
    ones = [sum((F.bit_count(x[i]) for x in maps[1:]), F.bit_count(maps[0][i])) for i in (0, 1)]
    both = sum((F.bit_count(x.bitwiseAND(y)) for x, y in maps[1:]), F.bit_count(maps[0][0].bitwiseAND(maps[0][1])))
    return both + F.least(n - ones[0], m - ones[1]) >= need


def _first_round(sets: DataFrame, similarity: float) -> DataFrame:
    """later, later_id, earlier, earlier_id, times: sets and those of their leaders that they may be similar to; times: words by which they meet."""
    size_class = F.floor(F.log("n") / F.log(F.lit(LEAD_RATIO)))
    folded = F.col("map0").bitwiseOR(F.col("map1"))  # the map of 64 bits
    rows = sets.select(F.explode("lead").alias("word"), "key", "id", "line", "n", size_class.alias("class"), folded.alias("map")).select(F.xxhash64("word", "class").alias("bucket"), "key", "id", "line", "n", "map")
    leaders = rows.groupBy("bucket", F.pmod("key", F.lit(LEADERS)).alias("turn")).agg(F.min(F.struct("id", "line", "key", "n", "map")).alias("of"))
    before = (F.col("of.id") < F.col("id")) | ((F.col("of.id") == F.col("id")) & (F.col("of.line") < F.col("line")))
    may = _may_share(F.col("n"), F.col("of.n"), [(F.col("map"), F.col("of.map"))], similarity)
    met = rows.join(leaders, "bucket").where(before & (F.col("of.key") != F.col("key")) & may)
    met = met.select(F.col("key").alias("later"), F.col("id").alias("later_id"), F.col("of.key").alias("earlier"), F.col("of.id").alias("earlier_id"))
    return met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("times"))


def _open(sets: DataFrame, settled: DataFrame, part: int) -> DataFrame:
    """The sets with a column open: not settled, and words array<long>: those of the prefix that are of a part, each with its place.
    Only sets that a map of the settled ones leaves in doubt are joined with them."""
    bits = bitmap(settled.select(F.col("key").alias("h")))
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(6)
            ends = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy()[ends[0] : ends[-1]]
            owner = np.repeat(np.arange(len(lists)), np.diff(ends))
            place = np.arange(len(words)) - (ends[:-1] - ends[0])[owner]
            mine = words % PARTS == part
            starts = np.searchsorted(owner[mine], np.arange(len(lists) + 1)).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(starts), pa.array(words[mine].astype(np.int64) << 32 | place[mine]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], packed, pa.array(~marked(batch.column(0).to_numpy().view(_U), bits))], names=names)

    names = [*_SET[:6], "words", "open"]
    seen = sets.select(*_SET[:7]).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _SET[:6]) + ", words array<long>, open boolean")
    doubt = seen.where("not open").drop("open").join(settled.select("key", F.lit(False).alias("open")), "key", "left").withColumn("open", F.col("open").isNull())
    return seen.where("open").unionByName(doubt)


def _second_round(sets: DataFrame, similarity: float) -> DataFrame:
    """later, later_id, earlier, earlier_id: open sets and all earlier sets that they may be similar to, as far as ``words`` tell."""
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("w").bitwiseAND(F.lit(0xFFFFFFFF)), 1) + F.col("open").cast("long")
    rows = sets.select(F.explode("words").alias("w"), "key", "id", "line", "n", "map0", "map1", "open").select(F.shiftright("w", 32).cast("int").alias("word"), "key", "id", "line", "map0", "map1", packed.alias("at"))
    side = lambda s: rows.select("word", *[F.col(c).alias(f"{s}_{c}") for c in rows.columns[1:]])
    t, eps = F.lit(similarity), F.lit(1e-9)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    n, m = (F.shiftright(x("at"), 32) for x in (a, b))
    behind = [size - F.shiftright(x("at").bitwiseAND(F.lit(0xFFFFFFFF)), 1) - 1 for x, size in ((a, n), (b, m))]
    is_open = [x("at").bitwiseAND(F.lit(1)) == 1 for x in (a, b)]
    smaller = (m < n) | ((m == n) & (b("key") < a("key")))
    # a pair is found at the first word it shares: before that nothing, after it what is left of the shorter side
    first_shared = F.lit(1) + F.least(*behind) >= F.lit(similarity / (1 + similarity)) * (n + m) - eps
    b_first = (b("id") < a("id")) | ((b("id") == a("id")) & (b("line") < a("line")))
    a_first = (a("id") < b("id")) | ((a("id") == b("id")) & (a("line") < b("line")))
    wanted = (b_first & is_open[0]) | (a_first & is_open[1])
    pairs = side("a").join(side("b"), "word").where(smaller & (m >= t * n - eps) & first_shared & _may_share(n, m, [(a(f"map{j}"), b(f"map{j}")) for j in (0, 1)], similarity) & wanted)
    pick = lambda c: (F.when(b_first, a(c)).otherwise(b(c)), F.when(b_first, b(c)).otherwise(a(c)))
    (later, earlier), (later_id, earlier_id) = pick("key"), pick("id")
    return pairs.select(later.alias("later"), later_id.alias("later_id"), earlier.alias("earlier"), earlier_id.alias("earlier_id")).distinct()


def _sets(texts: DataFrame, levels: np.ndarray, pairs: DataFrame) -> DataFrame:
    """key, words of the distinct sets of ``pairs``; words: 6 bytes each, rarest first. Only texts that hold some of them are read into sets."""
    both = lambda c: pairs.select(F.explode(F.array(f"later{c}", f"earlier{c}")).alias("key"))
    in_text = bitmap(both("_id").select(F.xxhash64("key").alias("h")))
    in_sets = bitmap(both("").select(F.col("key").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = levels.astype(_U)
        for batch in slices(batches):
            batch = batch.filter(pa.array(marked(batch.column(1).to_numpy().view(_U), in_text)))
            if not batch.num_rows:
                continue
            data, offsets = text_buffer(batch.column(0))
            for a, b in chunks(batch, offsets):
                lines = _Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], full)
                at = np.flatnonzero(marked(lines.key, in_sets))
                _, one = np.unique(lines.key[at], return_index=True)
                at = at[one]
                words = [pack(lines.codes[i : i + n]) for i, n in zip(lines.at[at].tolist(), lines.size[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.key[at].astype(np.int64)), pa.array(words, pa.binary())], names=["key", "words"])

    return texts.select("text", F.xxhash64("id").alias("h")).mapInArrow(run, "key long, words binary").groupBy("key").agg(F.first("words").alias("words"))


def _similar(x: pa.Array, y: pa.Array, similarity: float) -> np.ndarray:
    """Whether each pair of packed sets is at least so similar. All words of a batch are sorted at once, under the number of their pair."""
    codes, sizes = [], []
    for column in (x, y):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        sizes.append(np.diff(ends) // 6)
        codes.append(unpack(bytes(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])) | np.repeat(np.arange(len(column), dtype=_U), sizes[-1]) << _U(48))
    both = np.sort(np.concatenate(codes))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(48)).astype(np.int64), minlength=len(x))
    return shared >= similarity * (sizes[0] + sizes[1] - shared) - 1e-9


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """key: the later sets of the pairs that are at least so similar."""
    of = lambda side: sets.select(F.col("key").alias(side), F.col("words").alias(f"{side}_words"))
    both = pairs.select("later", "earlier").join(of("later"), "later").join(of("earlier"), "earlier").select("later", "later_words", "earlier_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(_similar(part.column(1).cast(pa.binary()), part.column(2).cast(pa.binary()), similarity)))], names=["key"])

    return both.mapInArrow(run, "key long").distinct()


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, line (from 0): the lines of ``docs`` that repeat an earlier line.

    Lines end at line feeds; words end at ASCII white space and are compared in lower case. Lines without a
    word, null texts and rows without id have no part. Lines at the same place of rows that share an id are
    neither earlier nor later.
    """
    texts = _texts(docs, id_col, text_col)
    survey = save(_survey(texts), "lines-survey", dictionary=False)
    levels = _levels(survey)
    lines = survey.where("counts is null").select("key", "id", "line")
    repeated = save(lines.groupBy("key").agg(F.min(F.struct("id", "line")).alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key", "first"), "lines-repeated")
    prefixes = save(_prefixes(texts, levels, bitmap(repeated.select(F.col("key").alias("h"))), similarity), "lines-prefixes", dictionary=False)

    firsts = save(_firsts(prefixes), "lines-firsts")
    each = prefixes.where("single").select(*_SET).unionByName(firsts)

    leading = save(_first_round(each, similarity), "lines-leading")
    sets = save(_sets(texts, levels, leading), "lines-led")
    best = leading.groupBy("later").agg(F.max_by("earlier", F.struct("times", "earlier")).alias("earlier"))
    settled = save(_verify(best, sets, similarity), "lines-settled")
    rest = leading.select("later", "earlier").join(settled.select(F.col("key").alias("later")), "later", "left_anti")
    settled = settled.unionByName(save(_verify(rest, sets, similarity), "lines-settled"))
    discard(leading, sets)

    parts = []
    for part in range(PARTS):
        parts.append(save(_second_round(_open(each, settled, part), similarity), "lines-pairs"))
    discard(prefixes, firsts)
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    gone = settled.unionByName(save(_verify(pairs, _sets(texts, levels, pairs), similarity), "lines-more"))
    discard(*parts)

    told = gone.select("key", F.lit(None).cast(repeated.schema["first"].dataType).alias("first")).unionByName(repeated)
    told = told.groupBy("key").agg(F.max(F.col("first").isNull()).alias("gone"), F.min("first").alias("first"))
    return lines.join(told, "key").where(F.col("gone") | (F.struct("id", "line") > F.col("first"))).select("id", "line").distinct()


def cleaned(text: Column, removed: Column) -> Column:
    """The text without the lines whose numbers are in ``removed``."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(text)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows and columns of ``docs``, with ``text`` cleaned, plus n_lines, n_removed and removed array<int> (ascending).

    n_lines: lines of the text that are not empty. A null text stays null and has none. Rows that share an id lose the
    lines that any of them loses. A text that loses all its lines is left empty. An empty table gives no rows. Columns
    of ``docs`` called n_lines, n_removed or removed give way to the operator's own.
    """
    gone = later_lines(docs, id_col, text_col, similarity).groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    numbered = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    text, removed = F.col(f"c{kept.index(text_col)}"), F.coalesce("lines", F.array().cast("array<int>"))
    count = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda s: s != "")), F.lit(0)))
    return numbered.join(gone, "id", "left").select(
        *[(cleaned(text, removed) if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept)], count.cast("int").alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed")
    )
