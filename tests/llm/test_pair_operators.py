"""Near-duplicates of texts, lines and vectors, nearest neighbours, and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import components as cc
from siftwell.llm import hashing, itq_neardup, line_dedup, order_minhash, prefix_forest, queries
from siftwell.llm.common import save


def test_word_hashes_depend_on_the_word_alone():
    data = np.frombuffer("ab  cd\nab é".encode(), np.uint8)
    h, start = hashing.hash_words(data)
    assert len(h) == 4 and h[0] == h[2] and len(set(h.tolist())) == 3 and start.tolist() == [0, 4, 7, 10]
    assert len(hashing.hash_words(np.zeros(0, np.uint8))[0]) == 0


def classes(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2)) if a != b] + [(200 + i, 201 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes(edges, {n for e in edges for n in e})
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- texts


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    sh = {i: order_minhash.shingles(np.frombuffer(t.encode(), np.uint8)) for i, t in text.items()}
    ids = sorted(text)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if text[a] == text[b] or order_minhash.aligned(sh[a], sh[b]) >= 0.8]
    found, links = order_minhash.near_duplicates(docs)
    assert {r.doc_id: r.class_id for r in found.collect()} == classes(edges, ids)
    assert all(0.8 <= r.similarity <= 1 for r in links.collect())


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_exact_where_it_can_reach_the_threshold():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.permutation(80).astype(np.uint64)
        y = list(x)
        for _ in range(rng.integers(0, 8)):
            i, kind = rng.integers(0, len(y)), rng.integers(0, 3)
            if kind == 0:
                y[i] = 1000 + rng.integers(0, 1000)
            elif kind == 1:
                y.pop(i)
            else:
                y.insert(rng.integers(0, len(y)), y.pop(i))
        y = np.array(list(dict.fromkeys(y)), np.uint64)
        m = lcs(x.tolist(), y.tolist())
        want = m / (len(x) + len(y) - m)
        got = order_minhash.aligned(x, y)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_order_counts():
    words = [f"w{i}" for i in range(100)]
    a = order_minhash.shingles(np.frombuffer(" ".join(words).encode(), np.uint8))
    b = order_minhash.shingles(np.frombuffer(" ".join(words[50:] + words[:50]).encode(), np.uint8))
    assert len(set(a.tolist()) & set(b.tolist())) > 90 and order_minhash.aligned(a, b) == 0.0
    again = order_minhash.shingles(np.frombuffer(b"a b c d e " * 5, np.uint8))
    assert len(set(again.tolist())) == len(again)  # labels make repeats distinct


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(odd_docs)[0].collect()}
    assert found[1] == found[2] == found[3] == 1 and found[5] == found[6] == 5 and found[4] == 4 and found[7] == 7
    kept = order_minhash.keep_one(odd_docs.unionByName(odd_docs)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5, 7, 8, 9, 10] and kept[0].key == "clash"
    assert order_minhash.near_duplicates(no_docs)[0].count() == 0 and order_minhash.keep_one(no_docs).count() == 0


def test_a_large_group_of_near_copies_stays_one_class(spark):
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if j != i % 150 else f"x{i}" for j, w in enumerate(words))) for i in range(400)]
    found = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0]
    assert {r.class_id for r in found.collect()} == {0}


def test_rows_of_one_id_are_classed_by_their_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1), (1, "something else entirely", 2), (2, text + " end", 3), (2, "a third text stands here", 4), (None, text, 5), (3, " ".join(f"v{i}" for i in range(40_000)), 6), (4, " ".join(f"v{i}" for i in range(10, 40_010)), 7)], "doc_id long, text string, digest int")
    found = {(r.doc_id, r.class_id) for r in order_minhash.near_duplicates(docs)[0].collect()}
    assert found == {(1, 1), (2, 1), (2, 2), (3, 3), (4, 3)}
    assert sorted(r.digest for r in order_minhash.keep_one(docs).collect()) == [1, 2, 4, 5, 6]


def test_groups_that_no_leader_joins(spark):
    """A chain in which each text is near to its neighbours only, all in buckets of one another."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sh = [order_minhash.shingles(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    edges = [(a, b) for a in range(50) for b in range(a + 1, 50) if order_minhash.aligned(sh[a], sh[b]) >= 0.8]
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs)[0].collect()} == classes(edges, range(50))


# -- lines


def brute_lines(rows):
    seen, gone = [], {}
    for doc, number, words in sorted((i, n, frozenset(line.split())) for i, t in rows for n, line in enumerate((t or "").lower().split("\n"))):
        if not words:
            continue
        if any(len(words & o) >= 0.8 * len(words | o) - 1e-9 for o in seen):
            gone.setdefault(doc, []).append(number)
        seen.append(words)
    return gone


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{int(i)}" for i in rng.zipf(1.4, 4000) % 900]
    base = [list(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(150)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.integers(0, 6)):
            line = list(base[rng.integers(0, len(base))])
            for _ in range(rng.integers(0, 4)):
                line[rng.integers(0, len(line))] = str(rng.choice(vocabulary))
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(df).collect() if r.removed}
    assert got == brute_lines(rows) and got


def test_short_lines_against_brute_force(spark):
    """Lines of one to six words, with no floor of the operator's own in the comparison."""
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 7))) for _ in range(5))) for i in range(40)]
    rows += [(100, "home\nthe the the the the the"), (101, "read more\nThe\n\n \nhome"), (102, "one two three four"), (103, "one two three four five"), (104, "one two three"), (105, "two one\t four three")]
    sets = [(i, n, frozenset(line.lower().split())) for i, t in rows for n, line in enumerate(t.split("\n"))]
    want = {}
    for k, (i, n, x) in enumerate(sets):
        if x and any(y and len(x & y) >= 0.8 * len(x | y) - 1e-9 for _, _, y in sets[:k]):
            want.setdefault(i, []).append(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(df).collect() if r.removed}
    assert got == want and got[101] == [1, 4] and got[103] == [0] and got[105] == [0]
    few = spark.createDataFrame([(1, "a b"), (2, "b a\nc")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(few).collect()} == {1: [], 2: [0]}


def test_lines_with_clashing_columns_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx y z", 7, 8, 9, "q"), (1, "x y z\nnew words here", 7, 8, 9, "q"), (2, "a b c d e f", 7, 8, 9, "q"), (None, "a b c d e", 7, 8, 9, "q")], "doc_id long, text string, removed int, n_lines int, n_removed int, removed_id string")
    out = line_dedup.dedup_lines(docs)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "removed_id", "n_lines", "n_removed", "removed"] and len(rows) == 4
    got = {(r.doc_id, r.text) for r in rows}
    # line 1 of document 1 repeats line 0 of its other row; both rows lose what either loses
    assert got == {(1, "a b c d e"), (1, "x y z"), (2, ""), (None, "a b c d e")}
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50_000))), (2, " ".join(f"w{i}" for i in range(100, 50_050)))], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(long).collect()} == {1: [], 2: [0]}


def test_lines_of_odd_rows(odd_docs, no_docs):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert out[1].removed == [] and out[2].removed == [0] and out[2].text == "" and out[3].removed == [0]
    assert out[9].removed == [0, 2] and out[9].text == "" and out[5].text is None and out[5].n_lines == 0 and out[8].removed == []
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_packing():
    codes = np.array([0, 5, (1 << 48) - 1], np.uint64)
    assert line_dedup.unpack(line_dedup.pack(codes)).tolist() == codes.tolist()


# -- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 32))
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 3) for i in range(400)]
    for i in range(60):  # near copies, some right at the threshold
        noise = rng.standard_normal(32)
        noise -= x[i] * (noise @ x[i]) / (x[i] @ x[i])
        angle = np.arccos(rng.choice([0.99, 0.95, 0.935, 0.925]))
        y = np.cos(angle) * x[i] / np.linalg.norm(x[i]) + np.sin(angle) * noise / np.linalg.norm(noise)
        rows.append((400 + i, [float(v) for v in np.float32(3 * y)], i % 3))
    rows += [(500, rows[7][1], 7 % 3), (501, rows[7][1], 7 % 3), (502, None, 1), (503, [0.0] * 32, 1), (504, [float("nan")] * 32, 1), (505, rows[8][1], None), (506, [None] + [1.0] * 31, 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (509, [], 1), (510, [1e-30] + [0.0] * 31, 2), (511, [5e-31] + [0.0] * 31, 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def test_vector_links_against_brute_force(vectors):
    rows, df = vectors
    unit = {i: np.array(v, np.float32).astype(float) / np.abs(np.array(v, np.float32).astype(float)).max() for i, v, label in rows if good(v) and label is not None}
    label = {i: lab for i, _, lab in rows}
    edges = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.93]
    n = Counter(x for e in edges for x in e)
    group = classes(edges, [r[0] for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq_neardup.near_vectors(df).collect()}
    assert got == {i: (n[i], group[i], group[i] == i) for i, _, _ in rows} and len(edges) > 40


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8, 0.92])
def test_links_with_a_common_direction(spark, common):
    """Vectors that share a direction, in clusters and apart: no link is lost where centring widens the angles."""
    rng = np.random.default_rng(9)
    axis = np.eye(32)[0]
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base + 0.35 * rng.standard_normal((60, 32)) for _ in range(5)] + [rng.standard_normal((500, 32))])
    x -= np.outer(x @ axis, axis)
    x = np.sqrt(common) * axis + np.sqrt(1 - common) * x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in itq_neardup.near_vectors(df).collect()}
    links, found = near.sum(), sum(got.values())
    assert found <= links and found >= 0.99 * links > 0
    assert (itq_neardup.plan(u, 800, 0.93)[1] == 0) == (common > 0.7)  # beyond that, all are compared, and none is lost
    assert common < 0.7 or found == links


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted(map(tuple, itq_neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False)]


def test_no_vectors(spark, vectors):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert itq_neardup.near_vectors(none).count() == 0
    assert itq_neardup.near_vectors(vectors[1].where("vec_id in (502, 503)")).count() == 2
    assert prefix_forest.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_against_brute_force(vectors):
    rows, df = vectors
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if good(v) and len(v) == 32}
    ids = sorted(usable)
    x = np.stack([usable[i] for i in ids])
    got: dict = {}
    for r in prefix_forest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    queries_ = [i for i in ids if i % 20 == 0]
    assert sorted(got) == queries_
    for q in queries_:
        s = x @ usable[q]
        best = [ids[j] for j in np.lexsort((np.arange(len(ids)), -s)) if ids[j] != q][:20]
        assert [k for k, _, _ in got[q]] == list(range(1, 21))
        hits += len(set(best) & {v for _, v, _ in got[q]})
        for _, v, score in got[q]:
            assert score == pytest.approx(float(usable[v] @ usable[q]), rel=1e-12) and v != q
    assert hits / (20 * len(queries_)) >= 0.9


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in prefix_forest.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]


# -- the pipeline


def test_stages_keep_columns_and_clean_documents(spark, odd_docs):
    import corpus_pipeline as p

    docs = odd_docs.select(*p.COLUMNS)
    named = dict(p.STAGES)
    kept = named["language_id"](spark, docs, "")
    assert kept.columns == p.COLUMNS and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 8, 9]
    lines = save(named["line_dedup"](spark, kept, ""), "t")
    assert lines.columns == p.COLUMNS and sorted(r.doc_id for r in lines.collect()) == [1, 4, 8]
    assert sorted(r.doc_id for r in named["near_dedup"](spark, lines, "").collect()) == [1, 4, 8]
    mixed = named["mixing"](spark, lines, "")
    assert mixed.columns == p.COLUMNS
    out = named["byte_bpe"](spark, lines, "")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_documents_of_unlearned_scripts_go(spark, sf_dir):
    import corpus_pipeline as p

    rng = np.random.default_rng(1)
    chinese = "".join(chr(0x4E00 + int(x)) for x in rng.zipf(1.3, 4000) % 3000)  # so long that some n-grams pass by chance
    strange = [(-1, "Это русский текст о погоде и о городе, в котором никто не живёт"), (-2, chinese), (-3, chinese[:200]), (-4, chinese[200:1200])]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*p.COLUMNS)
    more = docs.unionByName(spark.createDataFrame([(i, t, None, "src0", len(t)) for i, t in strange], docs.schema))
    kept = {r.doc_id for r in dict(p.STAGES)["language_id"](spark, more, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    """run() against a chain in plain Python: letters, similar lines, aligned texts, running sums (SQL), the rank file's library."""
    import hashlib

    import duckdb
    import pandas as pd
    import tiktoken
    from public_tokenizers import PATTERN

    import corpus_pipeline as p
    from siftwell.llm import spm_bpe
    from siftwell.llm.oracle import mix_sql

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")[p.COLUMNS]
    # near copies that line dedup leaves: the same words on one line, and one more
    copies = docs[docs.text.map(lambda t: t is not None and t.count("\n") > 3)].head(8)
    docs = pd.concat([docs, copies.assign(doc_id=copies.doc_id + 5000, text=copies.text.str.replace("\n", " ") + " end")], ignore_index=True)
    (tmp_path / "in").mkdir()
    docs.to_parquet(tmp_path / "in" / "documents.parquet")
    docs = docs[docs.text.map(lambda t: t is not None and any(c.isalpha() for c in t))]  # all four languages are learnt
    gone = brute_lines(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))
    rows = []
    for r in docs.itertuples(index=False):
        lines, out = r.text.split("\n"), set(gone.get(r.doc_id, []))
        if not out or len(out) < sum(x != "" for x in lines):
            rows.append(r._replace(text="\n".join(x for i, x in enumerate(lines) if i not in out)))
    text = {r.doc_id: r.text.lower() for r in rows}
    sh = {i: order_minhash.shingles(np.frombuffer(t.encode(), np.uint8)) for i, t in text.items()}
    ids = sorted(text)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if text[a] == text[b] or order_minhash.aligned(sh[a], sh[b]) >= 0.8]
    group = classes(edges, ids)
    stage3 = pd.DataFrame([r for r in rows if group[r.doc_id] == r.doc_id], columns=p.COLUMNS)
    con = duckdb.connect()
    con.register("stage3", stage3)
    copies = {r[0]: r[4] for r in con.execute(mix_sql("stage3")).fetchall()}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={e: i for i, e in enumerate(spm_bpe.codec(queries.tokenizer_path("byte_bpe_50k.tiktoken")).entries)}, special_tokens={})
    want = Counter()
    for r in stage3.itertuples(index=False):
        found = np.array(enc.encode_ordinary(r.text), dtype="<u4")
        want[(r.doc_id, len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())] += copies.get(r.doc_id, 0)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, str(tmp_path / "in")).collect())
    assert got == +want
    assert gone and len(stage3) < len(rows)


def test_pipeline_of_no_rows_and_of_repeated_ones(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(i % 3, "the house of the river and the hill\nsecond line of words", "en", "s0", 60) for i in range(9)] + [(None, "no id here but words", "en", None, 20), (7, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "copies" / "documents.parquet"))
    assert {r.doc_id for r in p.run(spark, str(tmp_path / "copies")).collect()} <= {0, None}


def test_every_operator_has_one_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_saved_tables_leave_no_shuffle_files(spark):
    from siftwell.llm.common import CLEANUP, discard, save

    def shuffled():
        return {f.getName() for f in _disk_files(spark) if f.getName().startswith("shuffle_")}

    old, before = spark.conf.get(CLEANUP, None), shuffled()
    counts = save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-clean")
    assert not shuffled() - before and spark.conf.get(CLEANUP, None) == old
    assert sum(r["count"] for r in counts.collect()) == 1000
    discard(counts)


def _disk_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    while found.hasNext():
        yield found.next()


def test_a_small_graph_is_written_in_few_files(spark):
    from pathlib import Path

    from siftwell.llm import components as cc

    names = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = cc.components(spark.range(200).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(Path(found.saved_at.removeprefix("file:")).glob("part-*.parquet"))) == 1
    assert {(r.node, r.component) for r in found.collect()} == {(i, i - i % 2) for i in range(400)}


def test_rounds_over_a_small_graph_shuffle_nothing_and_a_large_one_gives_the_same(spark, monkeypatch):
    import random

    plans, save = [], cc.save

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(cc, "save", noted)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    links = spark.createDataFrame(edges, "a long, b long")
    small = {tuple(r) for r in cc.components(links).collect()}
    assert len(plans) > 2 and not any("Exchange" in p for p in plans[1:])
    monkeypatch.setattr(cc, "FILE_ROWS", 50)
    plans.clear()
    assert {tuple(r) for r in cc.components(links).collect()} == small and all("Exchange" in p for p in plans)
    assert {(n, c) for n, c in small if n >= 1000} == {(1000 + i, 1000) for i in range(61)} | {(2000 + i, 2000) for i in range(101)}
    near = {}
    for a, b in edges[:200]:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for node, least in ((n, c) for n, c in small if n < 1000):
        seen, todo = {node}, [node]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        assert least == min(seen)
