"""Which sources of a language differ from each other, and by which words.

Every kept term of a language becomes one row with an array that holds its count in each source, in the order of the
language's sources (a wide term vector). Higher-order functions turn such a row into the contributions of all pairs of
sources, which are summed before they are shuffled, and into the contributions of each source against its language.

With count of a term in a group, N of all kept terms there and V kept terms, p = 1 + floor(10**9 * (count + 2) / (N + 2 V)).
Two groups differ by a term by floor((p - q)**2 / (p + q)). All of it is integer arithmetic: p in decimals of 38 digits,
differences in 64 bits (p is at most 10**9 + 1).

A language's sources lie in one array and give the square of their number in pairs, as the result has them; terms and
documents of a source or a language may be any share of all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, slices

#: Bytes of UTF-8 text: A to Z become small letters, all other ASCII characters but letters become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a language that have to hold a term.
LEAST_DOCUMENTS = 10
SCALE, PRIOR = 1_000_000_000, 2
#: Distinct terms of a language and source that a task holds before it hands its counts on.
HELD = 1 << 18


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text), without nulls -> lang, source, term, n occurrences, d rows that hold the term. Tasks count
    what they read before it is shuffled, so a hot source or term is a few rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: defaultdict = defaultdict(Counter)
        d: defaultdict = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                once = d[lang, source]
                terms = pa.array(list(found), pa.binary()).cast(pa.string())
                lang_source = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*lang_source, terms, pa.array(list(found.values()), pa.int64()), pa.array(list(map(once.__getitem__, found)), pa.int64())], names=names)
            n.clear()
            d.clear()

        for batch in slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = text.translate(_TERMS).split()
                n[lang, source].update(words)
                d[lang, source].update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from flush()
        yield from flush()

    names = ["lang", "source", "term", "n", "d"]
    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; null where no term is kept."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(PRIOR).cast("decimal(1,0)"))).cast("decimal(38,0)")
    below = (total.cast("decimal(19,0)") + F.lit(PRIOR).cast("decimal(1,0)") * terms.cast("decimal(18,0)")).cast("decimal(38,0)")
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", wide, below))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); the square stays below 2**63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """counts of ``term_counts`` -> lang, term, n and found (source -> n) of the terms that a language keeps."""
    whole = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("found"))
    return whole.where(F.col("d") >= least).select("lang", "term", "n", "found")


def languages(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per language: its sources in order, N of each (totals), V (terms) and N of the language (total)."""
    sizes = kept.select("lang", F.explode("found").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
    own = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    return sources.join(own, "lang", "left").select(
        "lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")
    )


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = 10) -> DataFrame:
    """docs(lang, source, text, ..) -> lang, source, part, item, value, rank.

    ``pair``: every other source of the language by the summed difference over its kept terms; ``term``: the ``top`` terms
    that the source has more often than its language, by their difference. Ranks by falling value, then by item.

    Null text, lang and source are ''. Repeated rows count each. A group without kept terms has p from the prior alone; a
    language without kept terms has pairs of value 0 and no term rows, one of a single source no pair rows. A table without rows gives none.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = save(vectors(term_counts(docs), least), "divergence-vectors")
    langs = save(languages(docs.select("lang", "source").distinct(), kept), "divergence-languages")  # Spark broadcasts it only if its files are small

    # a term's vector over the sources of its language: counts first, then p
    wide = kept.join(langs.withColumnRenamed("total", "lang_total"), "lang").withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s), F.lit(0))))
    wide = wide.withColumn("p", F.zip_with("counts", "totals", lambda n, t: probability(n, t, F.col("terms"))))

    last = F.size("sources") - 1
    upper = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: f(i, j))))
    of = lambda a, i: F.get(F.col(a), i)
    shares = wide.where(F.size("sources") > 1).select("lang", F.posexplode(upper(lambda i, j: difference(of("p", i), of("p", j)))).alias("number", "f"))
    summed = shares.groupBy("lang", "number").agg(F.sum("f").alias("value"))
    names = langs.where(F.size("sources") > 1).select("lang", F.posexplode(upper(lambda i, j: F.struct(of("sources", i).alias("a"), of("sources", j).alias("b")))).alias("number", "pair"))
    both = names.join(summed, ["lang", "number"], "left").select("lang", "pair.a", "pair.b", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = both.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), F.col("value")) for x, y in ("ab", "ba")])))

    own = wide.withColumn("q", probability(F.col("n"), F.col("lang_total"), F.col("terms")))
    more = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    terms = own.select("lang", F.col("term").alias("item"), F.inline(F.transform(more, lambda x: F.struct(x["sources"].alias("source"), difference(x["p"], F.col("q")).alias("value")))))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = terms.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank).select(*columns).unionByName(best.select(*columns))
