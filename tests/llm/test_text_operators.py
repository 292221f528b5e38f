"""Sharding, mixing, both tokenizations, attribution, token files, language ID."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import bitmask_langid as lang
from siftwell.llm import budget_mix, hash_tree_shards, queries, spm_bpe, token_attribution, token_store

BPE = queries.tokenizer_path("byte_bpe_50k.tiktoken")
WORDS = queries.tokenizer_path("word_bpe_49k.json")


# -- sharding


def draw(key: str, name: str, weight: float) -> float:
    bits = xxhash.xxh64(f"{key}/{name}".encode(), seed=42).intdigest() >> 12
    return -math.log((bits + 0.5) / 2.0**52) / weight


def brute_shard(key: str, leaves: list) -> int:
    for level in range(3):
        name = [lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/shard{x.shard}"][level]
        weights: dict = Counter()
        for x in leaves:
            weights[name(x)] += x.weight
        best = min(sorted(weights), key=lambda n: draw(key, n, weights[n]))
        leaves = [x for x in leaves if name(x) == best]
    return leaves[0].shard


def test_shards_follow_the_tree(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    small, large = hash_tree_shards.topology(16), hash_tree_shards.topology(17)
    rows = hash_tree_shards.assign_shards(docs, small, large).collect()
    for r in rows[:300]:
        assert r.shard == brute_shard(str(r.doc_id), small) and r.grown_shard == brute_shard(str(r.doc_id), large)
        assert r.text_crc32 == zlib.crc32(str(r.doc_id).encode()) and r.size == len(str(r.doc_id)) + 1
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("shards", [16, 17, 20])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = hash_tree_shards.assign_shards(docs, hash_tree_shards.topology(shards), hash_tree_shards.topology(shards + 1)).collect()
    assert all(r.grown_shard in (r.shard, shards) for r in rows) and any(r.grown_shard == shards for r in rows)


def test_rows_without_id_are_spread(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = hash_tree_shards.assign_shards(docs, hash_tree_shards.topology(16)).collect()
    assert len({r.shard for r in rows}) == 16 and len({(r.shard, r.slot) for r in rows}) == 400


def test_a_weight_moves_rows_of_its_subtree_only(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    leaves = hash_tree_shards.topology(16)
    heavier = [x._replace(weight=0.5) if x.shard == 3 else x for x in leaves]
    a = {r.doc_id: r.shard for r in hash_tree_shards.assign_shards(docs, leaves).collect()}
    b = {r.doc_id: r.shard for r in hash_tree_shards.assign_shards(docs, heavier).collect()}
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    # the lighter shard 3 gives to its rack, rack 0 to region 0, region 0 to region 1, and nothing else moves
    assert moved and all(x < 8 and (x < 4 or y >= 8) and (x >= 4 or y >= 4 or x == 3) for x, y in moved)


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = hash_tree_shards.assign_shards(odd_docs.unionByName(odd_docs), hash_tree_shards.topology(16)).collect()
    assert len(rows) == 20 and {r.size for r in rows if r.doc_id in (5, 6)} == {1} and {r.grown_shard for r in rows} == {None}
    assert hash_tree_shards.assign_shards(no_docs, hash_tree_shards.topology(16)).count() == 0


# -- mixing


def test_water_filling_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {(r.d, r.s): r.budget for r in budget_mix.leaf_budgets(leaves, ["d", "s"], [{}, {}], F.lit(600), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 290, ("b", "z"): 300}
    got = {(r.d, r.s): r.budget for r in budget_mix.leaf_budgets(leaves, ["d", "s"], [{"a": 9}, {}], F.lit(1500), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 490}


def test_mix_equals_sql(spark, sf_dir):
    import duckdb

    from siftwell.llm.oracle import mix_sql

    got = sorted(map(tuple, queries.op10_budget_mix(spark, sf_dir).collect()))
    want = sorted(duckdb.sql(mix_sql(f"read_parquet('{sf_dir}/documents.parquet')")).fetchall())
    assert got == want


def test_mix_of_odd_rows(odd_docs, no_docs):
    levels = {"lang": F.col("lang")}
    got = budget_mix.mix(odd_docs, levels, [{}], 1.0, 2).collect()
    assert {r.mix_copies for r in got} <= {1, 2} and all(r.key == "clash" for r in got)
    assert budget_mix.mix(no_docs, levels, [{}]).count() == 0


def test_mix_of_clashing_names(spark):
    names = ["n", "key", "bucket", "epoch", "copies_", "whole", "part", "edge", "before", "upto"]
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", i) for i in range(30)], "doc_id long, text string, mix_n string, mixing__n long")
    for name in names:
        out = budget_mix.mix(docs, {name: F.col("mix_n")}, [{}], 0.5, 2)
        rows = out.collect()
        assert rows and set(out.columns) == {"doc_id", "text", "mix_n", "mixing__n", f"mix_{name}", "mix_copies"} and all(r.mixing__n == r.doc_id for r in rows)
    with pytest.raises(ValueError):
        budget_mix.mix(docs, {"copies": F.col("mix_n")}, [{}])


def test_mix_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"w{i} x", "s") for i in range(40)], "doc_id long, text string, source string")
    rows = budget_mix.mix(docs, {"source": F.col("source")}, [{}], 0.5, 1).collect()
    assert len(rows) == 20


# -- byte-level BPE through sentencepiece

ODD = ["", " ", "it's  fine\n\n x", "'sup ''s", "naïve café ½ Ⅷ² 9", "\x1cA\x85B\xa0C", "a" * 3000, "中文 😀 ़", " end ", "tab\tx\n\ty"]


def test_bpe_equals_the_reference_library():
    import tiktoken
    from public_tokenizers import PATTERN

    codec = spm_bpe.codec(BPE)
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={e: i for i, e in enumerate(codec.entries)}, special_tokens={})
    for text in ODD + ODD:
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I")) == enc.encode_ordinary(text), text
        assert codec.decode(packed) == text.encode()


def test_bpe_of_odd_rows(odd_docs, no_docs):
    out = spm_bpe.encode_documents(odd_docs, BPE)
    back = {r.doc_id: r.text for r in spm_bpe.decode_documents(out, BPE).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd_docs.collect()}
    digests = {r.doc_id: r for r in spm_bpe.encode_documents(odd_docs, BPE, digests=True).collect()}
    assert digests[5].n_tokens == 0 and digests[5].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert spm_bpe.encode_documents(no_docs, BPE).count() == 0


# -- attribution


def brute_allocate(first, past, starts, ends):
    counts, outside = [0] * len(starts), 0
    for a, z in zip(first, past, strict=True):
        pieces: list = []  # runs of characters of one section or outside
        for c in range(a, z):
            own = next((i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s <= c < e), None)
            if pieces and pieces[-1][0] == own:
                pieces[-1][1] += 1
            else:
                pieces.append([own, 1])
        own = max(pieces, key=lambda p: p[1])[0]
        if own is None:
            outside += 1
        else:
            counts[own] += 1
    return counts, outside


def test_allocation_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 6, 12)
        past = np.cumsum(sizes)
        first = past - sizes
        cuts = np.sort(rng.choice(past[-1] + 1, 6, replace=False))
        starts, ends = cuts[0::2], cuts[1::2]
        counts, outside, _ = token_attribution.allocate(first, past, starts, ends)
        assert (list(counts), outside) == brute_allocate(first, past, starts, ends)


def test_attribution_of_odd_rows(odd_docs, no_docs):
    from public_tokenizers import PATTERN

    rows = {r.doc_id: r for r in token_attribution.attribute_tokens(odd_docs, BPE, PATTERN).collect()}
    assert rows[5].n_tokens == 0 and rows[5].section_tokens == [] and rows[4].n_sections == 2
    assert all(sum(r.section_tokens) + r.n_outside == r.n_tokens for r in rows.values())
    assert token_attribution.attribute_tokens(no_docs, BPE, PATTERN).count() == 0
    sectioned = odd_docs.withColumn("s", F.expr("array(named_struct('start', 2, 'end', 9), named_struct('start', 9, 'end', 900))"))
    rows = {r.doc_id: r for r in token_attribution.attribute_tokens(sectioned, BPE, PATTERN, "s").collect()}
    assert rows[1].n_outside >= 1 and sum(rows[1].section_tokens) + rows[1].n_outside == rows[1].n_tokens and rows[5].section_tokens == [0, 0]


def test_sections_with_nulls_and_overlaps(spark):
    from public_tokenizers import PATTERN

    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    sections = "array(named_struct('start', 11, 'end', 22), named_struct('start', cast(null as int), 'end', 5), named_struct('start', 0, 'end', 13), named_struct('start', 9, 'end', 3), named_struct('start', -4, 'end', 6))"
    (row,) = token_attribution.attribute_tokens(docs.withColumn("s", F.expr(sections)), BPE, PATTERN, "s").collect()
    assert row.section_tokens[1] == row.section_tokens[3] == row.section_tokens[4] == 0
    assert row.section_tokens[2] > 0 and row.section_tokens[0] > 0 and sum(row.section_tokens) + row.n_outside == row.n_tokens


def test_line_tokens_against_brute_force(spark, sf_dir):
    """Whole documents: each token's characters by decoding, each character's line by counting breaks."""
    import tiktoken
    from public_tokenizers import PATTERN

    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={e: i for i, e in enumerate(spm_bpe.codec(BPE).entries)}, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for r in token_attribution.attribute_tokens(docs, BPE, PATTERN).join(docs, "doc_id").collect():
        text = r.text or ""
        ids, offsets = enc.encode_ordinary(text), enc.decode_with_offsets(enc.encode_ordinary(text))[1]
        line = np.cumsum([0] + [c == "\n" for c in text])[:-1] if text else np.zeros(0, int)
        want = Counter()
        for a, raw in zip(offsets, map(enc.decode_single_token_bytes, ids), strict=True):
            n = sum((b & 0xC0) != 0x80 for b in raw) or 1
            want[Counter(line[a : a + n].tolist()).most_common(1)[0][0]] += 1
        assert r.n_tokens == len(ids) and {i: n for i, n in enumerate(r.section_tokens) if n} == dict(want)


def test_spans_hold_whole_characters():
    from public_tokenizers import PATTERN

    ids, first, past = token_attribution.token_spans("é😀x", BPE, PATTERN)
    assert first[0] == 0 and past[-1] == 3 and (past > first).all() and len(ids) == len(first)


# -- token files


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 500, n) for n in (1, 2, 255, 256, 257, 5000)] + [np.zeros(3000, int), np.tile([7, 8, 9], 2000), rng.zipf(1.3, 9000) % 49408]
    payloads = token_store.encode_blocks(blocks, 49408)
    for got, want in zip(token_store.decode_blocks(payloads), blocks, strict=True):
        assert (got == want).all()
    assert [(x == y).all() for x, y in zip(token_store.decode_blocks(payloads[5:6]), blocks[5:6], strict=True)] == [True]
    assert len(payloads[7]) < 2000  # what repeats costs little


def test_damage_is_noticed():
    payload = bytearray(token_store.encode_blocks([np.arange(3000) % 700], 49408)[0])
    payload[-9] ^= 255
    with pytest.raises((ValueError, IndexError)):
        token_store.decode_blocks([bytes(payload)])


def test_token_files(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(WORDS), 0
    blocks = token_store.write_tokens(odd_docs, WORDS)
    rows = {r.doc_id: r for r in token_store.read_tokens(blocks).collect()}
    for d in sorted(odd_docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(no_docs, WORDS), ids=False).count() == 0


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(WORDS), 0
    texts = ["a <|endoftext|> b", "<|startoftext|>Word<|endoftext|><|endoftext|>\nword", "<|ENDOFTEXT|> <| endoftext |> x<|endoftext|", "plain words"]
    blocks = token_store.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS)
    rows = {r.doc_id: r for r in token_store.read_tokens(blocks).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32, bytes(rows[i].ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert np.frombuffer(rows[0].ids, "<u4").tolist() == [320, 49407, 321, 1]


def test_token_files_of_other_rows(spark):
    """Null and repeated ids, odd characters, and a document longer than a block."""
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORDS), np.random.default_rng(6)
    letters = list("abcXYZ '.,!?0129<|>éßΣ日\u0301\n\t-_\"()\x0b\x1c\x85")
    rows = [(int(i) if i else None, "".join(rng.choice(letters, rng.integers(0, 60)))) for i in rng.integers(0, 40, 200)] + [(77, " ".join(f"w{i}" for i in range(60_000)))]
    found = token_store.read_tokens(token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS)).collect()
    want = Counter((i, np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == want
    place = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))


# -- language ID


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op7_bitmask_langid(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().merge(got, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id] == docs.held_out.tolist()
    held = docs[docs.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and docs.score.between(0, 1).all()


def test_prediction_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in lang.identify(odd_docs).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {5, 6, 7, 10}
    assert lang.identify(no_docs).count() == 0
    none = {r.lang_pred for r in lang.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert none == {"und"}


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "the house of the", "en") for i in range(8)] + [(100, "½ ² Ⅷ", None), (101, "x", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in lang.identify(docs).collect()}
    assert (rows[100].lang_pred, rows[100].score) == ("und", 0.0) and rows[101].lang_pred == "en"


def test_kept_columns_may_be_called_as_its_own(spark):
    docs = spark.createDataFrame([(1, "the house", "en", 5, "a", "b", 0.5)], "doc_id long, text string, lang string, held_out int, text_in string, text_low string, score double")
    out = lang.identify(docs, keep=docs.columns)
    (row,) = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "held_out", "text_in", "text_low", "lang_pred", "score"] and (row.held_out, row.text_in, row.text_low) == (5, "a", "b")
    repeated = lang.identify(docs.unionByName(docs).withColumn("text", F.repeat(F.lit("the house of the "), 20_000)))
    assert [r.lang_pred for r in repeated.collect()] == ["en", "en"]


def brute_identify(texts, members, false_rate):
    """Corrected counts by Python sets of n-grams, filters given as a test of membership."""
    out = []
    for text in texts:
        folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode())
        grams = [folded[i : i + n] for n in lang.GRAMS for i in range(len(folded) - n + 1)]
        grams = [g for g in grams if b"  " not in g]
        found = [max(0.0, (sum(g in m for g in grams) - len(grams) * f) / (1 - f)) for m, f in zip(members, false_rate, strict=True)]
        best = found.index(max(found))
        two = sum(sorted(found)[-2:])
        out.append((best, found[best] / two if two else 0.0))
    return out


def test_prediction_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(80)
    filters = lang.fit(docs, F.lit(True))
    texts = {r.doc_id: r.text for r in docs.collect()}

    class Member:
        def __init__(self, bit):
            self.bit = bit

        def __contains__(self, gram):
            packed = np.array([int.from_bytes(bytes([len(gram)]) + gram, "big")], dtype=np.uint64)
            return all(int(filters.masks[at[0]]) >> self.bit & 1 for at in lang.slots(packed))

    want = brute_identify(texts.values(), [Member(i) for i in range(len(filters.languages))], filters.false_rate)
    got = {r.doc_id: r for r in lang.identify(docs, filters).collect()}
    for (i, t), (best, score) in zip(texts.items(), want, strict=True):
        if any(c.isalpha() for c in t):
            assert got[i].lang_pred == filters.languages[best] and got[i].score == pytest.approx(score)


def test_filters_return_every_language_of_an_ngram():
    grams = [np.array([1, 2, 3], np.uint64), np.array([3, 4], np.uint64)]
    f = lang.build(["a", "b"], grams)
    at = lang.slots(np.array([1, 3, 4, 99], np.uint64))
    mask = f.masks[at[0]] & f.masks[at[1]] & f.masks[at[2]]
    assert mask.tolist() == [1, 3, 2, 0]


def test_workers_forget_the_chunks_of_a_task(spark):
    import pyarrow as pa

    from siftwell.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', 'some', concat('word', id), 'here') AS text")
    assert spm_bpe.encode_documents(docs, path, digests=True).where("n_tokens > 2").count() == 400

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(spm_bpe.codec(path).memory)] * batch.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}
