"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import queries as q
from siftwell.llm.common import discard, save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no learned language shows, go; all others stay."""
    from siftwell.llm.bitmask_langid import identify

    return identify(docs, keep=COLUMNS, shown=True).where("shown").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of a line go; a document that had lines and loses them all goes too. n_chars follows the text."""
    from siftwell.llm.line_dedup import dedup_lines

    out = dedup_lines(docs)
    return out.where("n_removed = 0 or n_removed < n_lines").select(
        "doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    from siftwell.llm.order_minhash import keep_one

    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents, each as often as its leaf's epochs repeat it."""
    from siftwell.llm.budget_mix import mix

    out = mix(docs, q.mix_levels(), q.MIX_WEIGHTS, q.MIX_SHARE, q.MIX_EPOCHS, q.MIX_SEED)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return q.bpe_digests(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = save(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-dedup and line dedup cannot be put as SQL that ends in useful time; tests compare with a brute-force version.
ORACLE_SQL = None
