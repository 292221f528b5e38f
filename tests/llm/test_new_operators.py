"""Spelling variants, source divergence, sentencepiece encoding by merge rounds."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import piece_rounds, queries, source_divergence, spelling_variants

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


# -- spelling variants


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(zip(b, row, row[1:], strict=False), lambda left, t: min(left + 1, t[2] + 1, t[1] + (x != t[0])), initial=i))
    return row[-1]


def brute_variants(docs: list[tuple], least_length: int = 6, least: int = 5, ratio: int = 5) -> list[tuple]:
    counts: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def variant_rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_equal_brute_force_on_made_words(spark):
    rng = random.Random(5)
    letters = "abcdefghéü×÷Éz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words += ["abcabc", "abcabd", "abcab", "bbbbbb", "bbbbbbb", "eeeeee", "aaaaaa", "aaaaaaa", "adadad", "adgadg", "adgada"]
    for w in list(words):
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]
    docs = [(i, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice([".", " -", "中", "_", "1"]) for w in rng.choices(words, k=90))) for i in range(120)]
    docs += [(1000 + i, f"{'chains ' * 5 ** (4 - k)}") for k, i in enumerate(range(3))] + [(2000, "chainþs " * 60 + "chaunþs " * 9)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    want = brute_variants(docs)
    assert variant_rows(spelling_variants.spelling_variants(df)) == want
    assert sum(r[4] > 0 for r in want) > 50 and any(r[1] for r in want)


def test_forms_are_followed_to_the_root(spark):
    chain = [("aabbcc", 6), ("aabbcd", 31), ("aabbdd", 160), ("aabedd", 900), ("xabedd", 5000)]
    docs = [(1, " ".join(f"{w} " * n for w, n in chain))]
    got = variant_rows(spelling_variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_variants(docs)
    assert got == want and {r[2] for r in want if r[0] in ("aabbcc", "aabbcd")} == {"xabedd"}


def test_variants_of_table_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    assert variant_rows(spelling_variants.spelling_variants(spark.createDataFrame(rows, docs.schema))) == brute_variants(rows)


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] * 2
    assert variant_rows(spelling_variants.spelling_variants(odd_docs.unionByName(odd_docs))) == brute_variants(rows)
    nameless = spark.createDataFrame([(None, "sevens " * 900)], "doc_id long, text string")
    assert variant_rows(spelling_variants.spelling_variants(nameless)) == brute_variants([("", "sevens " * 900)])
    assert spelling_variants.spelling_variants(no_docs).count() == 0


# -- source divergence


def brute_divergence(rows: list[tuple], least: int, top: int = 10) -> list[tuple]:
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted({s for x, s in counts if x == lang}, key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(-sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(-f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "Épsilon", "中文", "zeta", "\U0001f600\U0001f600", "eta", "theta", "iota"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "és", "s10", None, "S"]), " ".join(f"{w}{rng.choice(' ,3')}" for w in rng.choices(vocabulary, k=rng.randint(0, 30)))) for _ in range(300)]
    rows += [("xx", "only", "alpha beta"), ("yy", "one", None), ("yy", "two", "word"), ("en", "silent", "123 !"), ("en", "silent", None)]
    df = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], "lang string, source string, text string, n int, term string, p int")
    for least in (1, 10):
        assert divergence_rows(source_divergence.divergence(df, least)) == brute_divergence(rows, least)


def test_divergence_of_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()] * 2
    assert divergence_rows(source_divergence.divergence(odd_docs.unionByName(odd_docs), 2)) == brute_divergence(rows, 2)
    assert source_divergence.divergence(no_docs).count() == 0


def test_large_counts_stay_exact(spark):
    big = [("en", "a", "x", 4 * 10**17, 50), ("en", "b", "x", 7 * 10**16 + 1, 50), ("en", "a", "y", 1, 20)]
    counts = spark.createDataFrame(big, "lang string, source string, term string, n long, d long")
    kept = source_divergence.vectors(counts)
    r = kept.crossJoin(spark.range(1)).select(source_divergence.probability(kept.n, kept.n + 5, kept.n * 0 + 2).alias("p"), "n").collect()
    assert all(x.p == 1 + 10**9 * (x.n + 2) // (x.n + 5 + 4) for x in r)


def test_divergence_equals_sql(spark):
    import duckdb
    from test_catalogue import rows

    from siftwell.llm import oracle

    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.execute(oracle.oracle_sql()["op12_term_vectors"]).df()
    assert rows(queries.op12_term_vectors(spark, "/root/testdata/sf0.01").toPandas()) == rows(want) and len(want) > 1000


# -- sentencepiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(model, library, texts: list[str]) -> None:
    got = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    want = library.encode(texts, add_eos=True, num_threads=1)
    assert got == want
    assert [model.decode(np.array(x, "<u4").tobytes()) for x in want] == [library.decode(x) for x in want]


def test_rounds_equal_the_library_on_odd_texts(library):
    model = piece_rounds.PieceModel(MODEL)
    rng = random.Random(2)
    parts = ["a", "th", "ing", " ", "  ", "\n", "\r\n", "\t", "▁", "é", "ß", "中", "国", "\U0001f600", "\x00", "12", ".", "<s>", "</s>", "<0x41>", "<unk>", "ключ", "​", "é"]
    texts = ["", " ", "a", " a ", "▁", " " * 40 + "x", " " * 3000, "a" * 4000, "ab" * 3000, "\n\n\n", "é" * 600]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (300, 511, 512, 513, 9000)]
    same(model, library, texts)
    same(model, library, texts[::-1])  # words are remembered now


def test_words_beyond_those_remembered_are_encoded_too(library, monkeypatch):
    monkeypatch.setattr(piece_rounds, "REMEMBERED", 3)
    model = piece_rounds.PieceModel(MODEL)
    for _ in range(2):
        same(model, library, ["the quick brown fox jumps", "over the lazy dog " + "x" * 100])
    assert len(model.memory) <= 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_rounds_equal_the_library_on_any_text(text):
    import sentencepiece

    same(piece_rounds.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), [text])


def test_any_ids_decode_as_in_the_library(library):
    model, rng = piece_rounds.piece_model(MODEL), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, *range(3, 300), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_piece_documents(spark, odd_docs, no_docs, sf_dir, library):
    docs = odd_docs.unionByName(odd_docs).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"), allowMissingColumns=True)
    encoded = piece_rounds.encode_documents(docs, MODEL)
    want = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = sorted((r.doc_id, library.decode(np.frombuffer(r.ids, "<u4").tolist()), len(r.ids) // 4 == r.n_tokens) for r in encoded.collect())
    assert got == [(i, t.replace("▁", " "), True) for i, t in want]
    assert sorted((r.doc_id, r.text) for r in piece_rounds.decode_documents(encoded, MODEL).collect()) == [(i, t.replace("▁", " ")) for i, t in want]
    digests = {r.doc_id: r for r in piece_rounds.encode_documents(odd_docs, MODEL, digests=True).collect()}
    for i, t in {(r.doc_id, r.text or "") for r in odd_docs.collect()}:
        ids = library.encode(t, add_eos=True)
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_rounds.encode_documents(no_docs, MODEL).count() == 0
