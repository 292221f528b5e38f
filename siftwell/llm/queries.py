"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    found, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rep", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import read_tokens, write_tokens

    blocks = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read_tokens(blocks, ids=False)


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_tree_shards import assign_shards, topology

    return assign_shards(table(spark, sf_dir, "documents"), topology(16), topology(17))


#: Production mixture of op10 and of the pipeline: the number in a source's name, modulo 4, is its domain.
MIX_WEIGHTS = ({"0": 4, "1": 3, "2": 2, "3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 1}, {})
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, 7


def mix_levels() -> dict:
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return {"domain": (number % 4).cast("string"), "lang": F.col("lang"), "source": F.col("source")}


def op4_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq_neardup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame) -> DataFrame:
    from .spm_bpe import encode_documents

    return encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), digests=True)


def op5_spm_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.transform("removed", lambda i: i.cast("string"))).alias("removed"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op7_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitmask_langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .token_attribution import attribute_tokens

    return attribute_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .budget_mix import mix

    out = mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_copies").cast("int").alias("copies"))


def op11_letter_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_rounds import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
