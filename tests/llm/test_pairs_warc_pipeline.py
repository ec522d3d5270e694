"""Joins on pairs, archives and the pipeline, against brute force."""

import base64
import collections
import gzip
import hashlib
import io
import random

import numpy as np
import pytest

import corpus_pipeline
from loam.llm import groups, jaccard, textkit, vectors, warc
from loam.store import workspace

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i + 1, n):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], least[find(i)], links[i]) for i in range(n)]


def near_rows(seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "one  two"), (6, "one two three")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 6, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            text = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(text)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_groups_and_links(spark, monkeypatch, small):
    if small:  # so that keys and groups stand in many blocks
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 8)
        monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 400)
        monkeypatch.setattr(jaccard, "VERIFY_ROWS", 10)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, bucket string, id int")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df.repartition(3)).collect())
    assert got == sorted(brute_groups(rows))


def test_jaccard_on_documents(spark):
    df = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect())
    assert got == sorted(brute_groups(rows))


def test_jaccard_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    again = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u")], "doc_id long, text string")
    got = jaccard.near_duplicates(again).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2] and len(got) == 4


def test_jaccard_classes_without_doc_ids(spark):
    """A class of null doc_ids bridges two that are too far apart, and a group of such keeps one row."""
    words = [f"w{k}" for k in range(64)]
    texts = {name: " ".join(words[k : k + 54]) for k, name in enumerate(("a", "b", "c", "d", "e", "f", "g", "h"))}
    a, b, c = texts["a"], texts["e"], " ".join(words[8:62])  # 46 of 54 shingles to the next, 42 to the one after
    x, y = " ".join(f"x{k}" for k in range(60)), " ".join(f"x{k}" for k in range(1, 60))
    rows = [(5, a), (None, b), (None, b), (9, c), (None, x), (None, y), (None, y)]
    assert [len(shingle_set(p) & shingle_set(q)) / len(shingle_set(p) | shingle_set(q)) >= 0.8 for p, q in ((a, b), (b, c), (a, c), (x, y))] == [True, True, False, True]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = sorted((r.doc_id or 0, r.n_links, r.kept) for r in got if r.class_id == 5)
    assert linked == [(0, 3, False), (0, 3, False), (5, 2, True), (9, 2, False)]
    rest = [r for r in got if r.class_id != 5]
    assert [r.n_links for r in rest] == [2, 2, 2] and len({r.class_id for r in rest}) == 1 and sum(r.kept for r in rest) == 1


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 8193])
def test_common_counts_the_last_shingle(n):
    value = np.tile(np.arange(n, dtype=np.uint64), 2)
    assert (jaccard.common(value, np.repeat([0, 1], n), 2) == n).all()


def test_pruning_keeps_pairs_at_the_threshold():
    for n, least in jaccard.least_matches():
        assert 0 < least < 0.8 * n
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 32, jaccard.HASHES, np.uint64).astype(np.uint32)
    others = np.stack([np.where(rng.random(jaccard.HASHES) < s, one, one + 1) for s in [0.8] * 300 + [0.2] * 300]).astype(np.uint32)
    alive = jaccard._likely(one, others, jaccard.least_matches())
    assert alive[:300].all() and not alive[300:].any()


def test_pruning_of_a_block_is_that_of_its_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (5, jaccard.HASHES), np.uint64).astype(np.uint32)
    sig = np.where(rng.random((200, jaccard.HASHES)) < rng.random(200)[:, None], base[rng.integers(0, 5, 200)], rng.integers(0, 1 << 32, (200, jaccard.HASHES))).astype(np.uint32)
    limits = jaccard.least_matches()
    want = np.stack([jaccard._likely(one, sig, limits) for one in sig])
    np.fill_diagonal(want, False)
    assert want.any() and not want.all() and (jaccard.survivors(sig, limits) == want).all()
    side = rng.integers(0, 2, 200)
    assert (jaccard.survivors(sig, limits, side) == (want & (side[:, None] != side[None, :]))).all()


def test_reach_is_that_of_the_links():
    rng = np.random.default_rng(4)
    for _ in range(20):
        linked = rng.random((40, 40)) < 0.02
        linked |= linked.T
        ids = rng.permutation(40)
        want = ids.copy()
        for _ in range(40):
            want = np.minimum(want, np.where(linked, want[None, :], 99).min(1))
        assert (groups.least_reached(ids, linked) == want).all()


def test_long_words_and_far_words_hash_alike_anywhere():
    import pyarrow as pa

    ab = lambda x, y, n: x if n == 0 else ab(x, y, n - 1) + ab(y, x, n - 1)
    long_, other = ab("a", "b", 11), ab("b", "a", 11)  # these cancel out in any polynomial modulo 2^64
    texts = [f"{long_} x", "y " * 700_000 + long_ + " x", f"{other} z", "q" * (textkit.SLICE_BYTES + 5)]
    data, offsets = textkit.string_bytes(pa.array(texts))
    starts, ends, doc = textkit.word_bounds(data, offsets)
    h = textkit.word_hashes(data, starts, ends)
    assert h[0] == h[doc == 1][-2] and h[1] == h[-4] and len({int(h[0]), int(h[doc == 2][0]), int(h[doc == 3][0])}) == 3
    assert len(set(h[doc == 1][:-2].tolist())) == 1


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        groups.components(chain, workspace(spark, "t"), most_rounds=1)


def test_recall_of_pairs_on_a_larger_table(spark):
    """Groups and links of all documents of sf0.01 that share a shingle with another, by brute force."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_groups(rows))


def test_minhash_estimates_similarity():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    a = [rng.choice(words) for _ in range(2000)]
    b = a[:1800] + [rng.choice(words) for _ in range(200)]
    import pyarrow as pa

    data, offsets = textkit.string_bytes(pa.array([" ".join(a), " ".join(b)]))
    value, where = jaccard.shingle_sets(data, offsets)
    *_, least = jaccard.signatures(value, where, 2)
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert (where == 0).sum() == len(x) and (where == 1).sum() == len(y)
    assert abs((least[0] == least[1]).mean() - len(x & y) / len(x | y)) < 0.15


def test_words_and_hashes_do_not_depend_on_the_slice():
    import pyarrow as pa

    texts = ["a b", None, "", " x\x0by ", "a b c a b c d", "é é é"]
    data, offsets = textkit.string_bytes(pa.array(texts))
    starts, ends, doc = textkit.word_bounds(data, offsets)
    import re

    want = [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert [(int(d), data[s:e].tobytes()) for s, e, d in zip(starts, ends, doc, strict=True)] == want
    hashes = textkit.word_hashes(data, starts, ends)
    same = collections.defaultdict(set)
    for (_, w), h in zip(want, hashes.tolist(), strict=True):
        same[w].add(h)
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200), (500, 500)]
    edges += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(50)]
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long"), workspace(spark, "t")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if k != 500}


def test_first_reached_is_that_of_the_pairs():
    rng = np.random.default_rng(6)
    for n, m in [(1, 0), (30, 12), (200, 150), (200, 900)]:
        i, j = rng.integers(0, n, (2, m))
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert (groups.first_reached(n, i, j) == want).all()


def vector_rows(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.3])).astype("float32").tolist(), int(g % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] * 16, 1), (n + 5, rows[0][1], None), (n + 6, [None] + [1.0] * 15, 1), (n + 7, [1.0] * 8, 0), (n + 8, [1.0] * 16, 0), (n + 9, [float("inf")] + [1.0] * 15, 0), (n + 10, [], 0)]
    return rows + [(n + 11, [x * 1e30 for x in rows[0][1]], 0), (n + 12, [x * 1e-30 for x in rows[0][1]], 0)]


@pytest.mark.parametrize("small", [False, True])
def test_vector_links_and_components(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "BLOCK", 4)
        monkeypatch.setattr(vectors, "FEW", 2)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, sound string")
    links, root = collections.Counter(), {r[0]: r[0] for r in rows}
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = [(i, v / np.abs(v).max(), lab) for i, v, lab in ok]
    pairs = [(i, j) for k, (i, v, a) in enumerate(ok) for j, w, b in ok[k + 1 :] if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == sorted((i, links[i], root[i], root[i] == i) for i, *_ in rows)


def test_vectors_of_over_a_thousand_lengths(spark):
    rows = [(k, [1.0] * k, 0) for k in range(1, 1003)] + [(2001, [1.0] * 1100, 0), (2002, [1.0] * 1099 + [1.1], 0), (2003, [2.0, 1.0], 1), (2004, [2.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = {i: (0, i, True) for i, *_ in rows} | {2001: (1, 2001, True), 2002: (1, 2001, False), 2003: (1, 2003, True), 2004: (1, 2003, False)}
    assert got == want


def test_vectors_of_any_scale_link_and_unsound_ones_do_not(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    odd = [[1.0, 2.0, 3.0, None], [1.0, 2.0, 3.0, float("nan")], [float("-inf"), 2.0, 3.0, 4.0], [1.0, 2.0, float("inf"), None], [0.0, -0.0, 0.0, 0.0], [None] * 4]
    scaled = [v, [x * 1e300 for x in v], [x * 1e-300 for x in v], [x * 4e307 for x in v], [-x for x in v]]
    df = spark.createDataFrame([(k, x, 0) for k, x in enumerate(scaled + odd)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {k: (3, 0) if k < 4 else (0, k) for k in range(len(scaled + odd))}


def test_vectors_with_labels_of_any_type(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    for schema, labels in (("string", ["a", "a", "b", None]), ("double", [1.2, 1.2, 1.7, None])):
        df = spark.createDataFrame([(k, v, x) for k, x in enumerate(labels)], f"vec_id long, embedding array<float>, label {schema}")
        near = spark.createDataFrame([(10 + k, [1.0, 2.0, 3.0, 4.1], x) for k, x in enumerate(labels)], df.schema)
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df.union(near)).collect()}
        assert got == {0: (3, 0), 1: (3, 0), 10: (3, 0), 11: (3, 0), 2: (1, 2), 12: (1, 2), 3: (0, 3), 13: (0, 13)}


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_keeps_lengths_and_hashing_recalls():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)
    k, tables = vectors.plan(50_000, 64)
    assert k >= 2 and tables < 60
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    hasher = vectors.Hasher(64, k, tables)
    salt = np.zeros(50, np.uint64)
    met = np.zeros(50, bool)
    seen_a, seen_b = list(hasher.buckets(a, salt)), list(hasher.buckets(b, salt))
    per = k + 1
    for t in range(tables):
        own_a, own_b = seen_a[t * per][0], seen_b[t * per][0]
        for p in range(per):
            met |= (seen_a[t * per + p][0] == own_b) | (seen_b[t * per + p][0] == own_a)
    assert met.all()


PAGES = [(9001, None, None), (9002, "u v", ""), (9003, "x\r\ny", "<a>é</a>"), (9004, "x", "<a>é</a>"), (9000, "z", "<a>é</a>"), (None, "n", "<a>é</a>"), (9000, "z", "<a>é</a>"), (9005, "w", "WARC/1.1\r\n\r\n" * 5), (9006, "big", "q" * 3_000_000)]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    df = spark.read.parquet(f"{SF}/pages.parquet").union(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    rows = df.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        p = (r.html or "").encode()
        again = r.page_id is not None and r.page_id > first[r.html or ""]
        want.append((r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[r.html or ""] if again else None))
    folder = workspace(spark, "t")
    written = warc.write_archives(df.withColumn("refers_to", df.url).select("page_id", "url", "html", "refers_to"), folder)
    indexed = warc.normalise(written, folder)
    assert written.agg({"n_records": "sum"}).first()[0] == indexed.agg({"n_records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(indexed).collect()
    assert sorted(map(str, want)) == sorted(str((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to)) for g in got)
    # an archive is one stream before, and whole members at the indexed offsets after
    name = written.first().archive.removeprefix("file://")
    whole = gzip.decompress(open(name, "rb").read())
    import zlib

    one = zlib.decompressobj(31)
    assert one.decompress(open(name, "rb").read()) == whole and one.eof and not one.unused_data
    name = indexed.first().archive.removeprefix("file://")
    data = open(name, "rb").read()
    for line in open(name + ".idx"):
        offset, length, kind, *_ = line.rstrip("\n").split("\t")
        record = gzip.decompress(data[int(offset) : int(offset) + int(length)])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())


def test_records_over_any_cut():
    parts = [warc.record(k, f"u{k}", b"x" * k, None) for k in range(5)]
    raw = b"".join(parts)
    for step in (1, 7, 64, 10_000):
        got = [block for _, _, block in warc.records(iter([raw[k : k + step] for k in range(0, len(raw), step)]))]
        assert len(got) == 5 and got[4].endswith(b"xxxx")
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-10]])))
    members = b"".join(gzip.compress(p) for p in parts)
    assert b"".join(warc.inflated(io.BytesIO(members))) == raw


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_hold_what_they_promise(spark, tmp_path):
    folder = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, folder).write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = (before, after)
        if name != "tokens":
            assert after.columns == columns
        before = after
    into, out = seen["near duplicates"]
    kept = {r.doc_id for r in out.collect()}
    assert kept == {c for _, c, _ in brute_groups([(r.doc_id, r.text) for r in into.collect()])}
    into, out = seen["personal data"]
    from tests.llm.test_text_models import brute_spans

    assert out.count() == into.count()
    assert not any(brute_spans(r.text) for r in out.collect()) and all(len(r.text) == r.n_chars for r in out.collect())
    into, out = seen["mixture"]
    times = collections.Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in into.collect()}
    into, out = seen["tokens"]
    assert out.count() == into.count() and out.filter("not round_trip").count() == 0


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "word " * 10 + "other " * 30, "en", "a", 1), (2, "", "en", None, 0), (3, " ".join(f"w{k}" for k in range(40)), "en", "a", 5), (3, " ".join(f"w{k}" for k in range(40)), "en", "a", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).select("doc_id").distinct().count() >= 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_keeps_texts_that_share_a_doc_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, loam_extra string"
    text = lambda k: " ".join(f"w{k}_{j}" for j in range(30))
    rows = [(1, text(1), "en", "a", 1, "x"), (1, text(2), "en", "a", 1, "x"), (1, text(1), "en", "b", 1, "x"), (2, text(1), "en", "a", 1, "x"), (None, text(3), "en", "a", 1, "x"), (None, text(3), "en", "a", 1, "x"), (None, text(4), "en", None, 1, "x")]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    seen = set()
    for parts in (1, 5):
        out = stage(spark, spark.createDataFrame(rows, schema).repartition(parts), "")
        assert out.columns == [c.split()[0] for c in schema.split(", ")]
        got = sorted((r.text, r.doc_id or 0, r.source or "") for r in out.collect())
        assert [t for t, *_ in got] == sorted(map(text, (1, 2, 3, 4))) and {x for x in got if x[1] == 0} == {(text(3), 0, "a"), (text(4), 0, "")}
        seen.add(tuple(got))
    assert len(seen) == 1
    assert stage(spark, spark.createDataFrame([], schema), "").count() == 0


def prefix_filter_links(rows, threshold=0.8):
    """Exact links by another way: sets at the threshold share one of their rarest shingles."""
    sets = [shingle_set(t) for _, t in rows]
    count = collections.Counter(x for s in sets for x in s)
    by_rare = collections.defaultdict(list)
    ordered = [sorted(s, key=lambda x: (count[x], x)) for s in sets]
    links = collections.defaultdict(set)
    for i, own in enumerate(ordered):
        seen = set()
        for x in own[: int((1 - threshold) * len(own)) + 2]:
            seen.update(by_rare[x])
            by_rare[x].append(i)
        for j in seen:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_every_link_of_the_large_documents_is_found(spark):
    df = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    links = prefix_filter_links(rows)
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(df).collect()}
    want = {i: len(links.get(k, ())) for k, (i, _) in enumerate(rows)}
    assert sum(want.values()) > 1000 and got == want


def test_every_link_of_the_large_vectors_is_found(spark):
    """All vectors of sf0.1 with near copies of every tenth, at cosines around the threshold."""
    df = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet")
    rng = np.random.default_rng(8)
    near = []
    for r in df.filter("vec_id % 10 = 0 and label is not null").collect():
        v = np.array(r.embedding, float)
        for k in range(3):
            noise = rng.normal(size=len(v))
            noise -= noise @ v / (v @ v) * v
            c = rng.uniform(0.92, 0.99)
            near.append((1_000_000 + 10 * r.vec_id + k, (c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).tolist(), r.label))
    df = df.select("vec_id", "embedding", "label").union(spark.createDataFrame(near, "vec_id long, embedding array<float>, label int"))
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in df.collect() if r.embedding is not None and r.label is not None]
    want = {}
    for label in {r[2] for r in rows}:
        own = [(i, v) for i, v, x in rows if x == label and np.isfinite(v).all() and v.any()]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        want |= {i: int(n) - 1 for (i, _), n in zip(own, (x @ x.T >= 0.93).sum(1), strict=True)}
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert sum(want.values()) > 500 and {i: n for i, n in got.items() if i in want} == want
