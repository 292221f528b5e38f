"""Groups of spelling variants: words one letter apart, each with its far more frequent form.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One edit flips one bit (a letter
more or less) or two (another letter), so of three bands of the mask one at least is equal, and two wherever the edit
stays within one band. Words are joined on their equal bands and on the lengths that such an edit allows, candidates
whose other bits differ in more than two places go, and the edit distance of the rest decides.

Letters of a band that an edit does not touch keep their order, too. So words with equal band bits are split further by those
letters and by how many letters lie in the touched bands; that also makes each pair meet exactly once:

* kind X (0 to 2): the edit stays in band X; the other two bands are equal, X has one letter more, or as many;
* kind 3 + C: a letter of one band gives way to one of another; band C is equal, the one has a letter less, the other one more.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices

#: The letters of words, as small letters; all of them lie in one byte of Latin-1.
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
BANDS = ["".join(LETTERS[b::3]) for b in range(3)]
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: One occurrence in so many, by its hash, loses a letter.
DROPPED = 199
#: Distinct words that a task holds before it hands its counts on.
HELD = 1 << 18


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """word, n: occurrences in all texts, counted by task before they are shuffled. A null id is written as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
            n.clear()
            return out

        crc32 = zlib.crc32
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line = (text or "").encode("latin-1", "replace").translate(_WORDS)
                words, seed = line.split(), crc32(f"{name or ''}:".encode())
                if line.isascii():
                    hashes = [crc32(w, seed) for w in words]
                else:
                    hashes = [crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) for w in words]
                n.update([w for w, h in zip(words, hashes, strict=True) if len(w) >= least_length and h % DROPPED])
                for w, h in zip(words, hashes, strict=True):
                    if not h % DROPPED and len(w) > least_length:
                        at = h % len(w)
                        n[w[:at] + w[at + 1 :]] += 1
            if len(n) > HELD:
                yield flush()
        if n:
            yield flush()

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keep(word: Column, letters: str) -> Column:
    """The word's letters that are among ``letters``, in order."""
    return F.translate(word, "".join(c for c in LETTERS if c not in letters), "")


def parity(letters: Column, band: str) -> Column:
    """The bits of one band: whether each of its letters occurs an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(band), c) - 1)
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n), distinct -> a, a_n, b, b_n: each pair of words that one edit turns into each other, once."""
    bands = words.withColumns({f"s{b}": keep(F.col("word"), BANDS[b]) for b in range(3)})
    bands = bands.withColumns({f"m{b}": parity(F.col(f"s{b}"), BANDS[b]) for b in range(3)} | {f"c{b}": F.length(f"s{b}") for b in range(3)})

    def row(kind: int, equal: list[int], letters: Column, x: Column | int, y: Column | int) -> Column:
        """A key: the equal bands' bits and letters, and the numbers of letters in the others; and the other bands' bits."""
        bits = F.lit(0).cast("long")
        other = F.lit(0).cast("long")
        for b in range(3):
            if b in equal:
                bits = F.call_function("shiftleft", bits, F.lit(30)).bitwiseOR(F.col(f"m{b}"))
            else:
                other = F.call_function("shiftleft", other, F.lit(30)).bitwiseOR(F.col(f"m{b}"))
        x, y = (F.lit(v).cast("int") if isinstance(v, int) else v for v in (x, y))
        return F.struct(F.lit(kind).alias("kind"), bits.alias("bits"), letters.alias("letters"), x.alias("x"), y.alias("y"), other.alias("other"))

    homes, probes = [], []
    for b in range(3):
        low, high = [o for o in range(3) if o != b]
        rest = keep(F.col("word"), BANDS[low] + BANDS[high])
        homes.append(row(b, [low, high], rest, F.col(f"c{b}"), 0))
        probes += [row(b, [low, high], rest, F.col(f"c{b}") + more, 0) for more in (0, 1)]
        homes.append(row(3 + b, [b], F.col(f"s{b}"), F.col(f"c{low}"), F.col(f"c{high}")))
        probes.append(row(3 + b, [b], F.col(f"s{b}"), F.col(f"c{low}") - 1, F.col(f"c{high}") + 1))
    side = lambda rows, name: bands.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.inline(F.array(*rows))).withColumnRenamed("other", f"{name}_other")
    met = side(probes, "a").where("y >= 0 and x >= 0").join(side(homes, "b"), ["kind", "bits", "letters", "x", "y"])
    met = met.where(F.bit_count(F.col("a_other").bitwiseXOR(F.col("b_other"))) <= 2)
    met = met.where((F.length("a") < F.length("b")) | (F.col("kind") >= 3) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``least_length`` letters that occurs ``least`` times.

    A word's form is the most frequent word one edit away (of equals the first in code-point order) if it occurs ``ratio``
    times as often, else null; its root is where forms lead to, or the word itself. Null and empty texts have no words; repeated rows count
    each. A table without words gives no rows. One occurrence in ``DROPPED``, chosen by a hash of id and word, counts as
    misspelt: it loses the letter that the hash names.
    """
    words = save(word_counts(docs, id_col, text_col, least_length).where(F.col("n") >= least), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")])))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    best = words.join(near, "word", "left").withColumn("form", F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best.other")))
    formed = save(best.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("best.minus")).alias("form_n")), "spelling-forms")

    # every step to a form multiplies n by the ratio, so chains are short; each round doubles how far a word has looked
    most = words.agg(F.max("n")).first()[0]
    longest = max(1, math.floor(math.log(most / least, ratio) + 1e-9)) if most and ratio > 1 else 1
    roots, reach = formed.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots, reach = save(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots"), 2 * reach
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
