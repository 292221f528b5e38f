"""Words that a polynomial hash cannot tell apart, and what operators leave behind in a session."""

import os
import zlib

import numpy as np
import pytest

from siftwell import session
from siftwell.llm import hashing, line_dedup, order_minhash, queries, token_store

WORDS = queries.tokenizer_path("word_bpe_49k.json")


def thue_morse(bits: int) -> tuple[str, str]:
    """A word of 2**bits letters and its complement: equal under every polynomial in an odd base modulo 2**64, for 10 bits and more."""
    ones = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


PAIR = thue_morse(10)


def test_hashes_differ():
    for bits in (3, 10, 12):
        hashes = hashing.hash_words(np.frombuffer(" ".join(thue_morse(bits)).encode(), np.uint8))[0]
        assert hashes[0] != hashes[1]
    rng = np.random.default_rng(1)
    words = {"".join(map(chr, rng.integers(97, 100, n))) for n in rng.integers(1, 40, 20000)}
    swapped = {w[8:16] + w[:8] + w[16:] for w in words if len(w) > 16}  # eights of bytes in another order
    both = sorted(words | swapped)
    assert len(set(hashing.hash_words(np.frombuffer(" ".join(both).encode(), np.uint8))[0].tolist())) == len(both)


def test_a_hash_depends_on_the_bytes_of_the_word_alone():
    for word in ("a", "abcdefg", "abcdefgh", "abcdefghi", "é" * 40, "x" * 1000):
        alone = hashing.hash_words(np.frombuffer(word.encode(), np.uint8))[0][0]
        for text in (f"{word} b", f"  zz\n{word}", f"zzzzzzz {word}\tq", f"{word} {word}"):
            assert alone in hashing.hash_words(np.frombuffer(text.encode(), np.uint8))[0]


def test_token_ids_of_the_pair(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(PAIR)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_store.read_tokens(token_store.write_tokens(docs, WORDS)).collect()}
    for i, w in enumerate(PAIR):
        ids = [*library.encode(w, add_special_tokens=False).ids, token_store.END_ID]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_lines_of_the_pair_stay(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(PAIR)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == dict(enumerate(PAIR))


def test_documents_of_the_pair_are_two_classes(spark):
    docs = spark.createDataFrame([(i, f"{w} one two three four five") for i, w in enumerate(PAIR)] + [(2, "one two")], "doc_id long, text string")
    sh = [order_minhash.shingles(np.frombuffer(f"{w} {w} x y z".encode(), np.uint8)) for w in PAIR]
    assert not set(sh[0].tolist()) & set(sh[1][:3].tolist())
    words = spark.createDataFrame([(i, " ".join([w] * 12)) for i, w in enumerate(PAIR)], "doc_id long, text string")
    for df in (docs, words):
        found, _ = order_minhash.near_duplicates(df)
        assert all(r.class_id == r.doc_id for r in found.collect())


def test_settings_of_the_session_stay(spark, odd_docs):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.checkpoint.dir")}
    token_store.read_tokens(token_store.write_tokens(odd_docs, WORDS)).count()
    order_minhash.near_duplicates(odd_docs)[0].count()
    assert {k: spark.conf.get(k) for k in before} == before


def test_tables_that_nothing_reads_are_removed(spark, odd_docs):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    order_minhash.near_duplicates(odd_docs.where("text is not null"))[0].count()
    left = {x.split("-")[1] + "-" + x.split("-")[2] for x in set(os.listdir(folder)) - before}
    assert not {x for x in left if x.startswith(("omh-first", "omh-second", "omh-third", "omh-crowded", "omh-apart"))}
    assert sum(x.startswith("siftwell-cc") for x in set(os.listdir(folder)) - before) <= 1


class _Conf:
    def __init__(self, master):
        self.values = {"spark.master": master}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    def __init__(self, master):
        self.conf = _Conf(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_has_to_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(_Session(master))


def test_local_mode_gets_a_folder():
    local = _Session("local[4]")
    assert session.shared_dir(local) == local.conf.get("spark.checkpoint.dir")
