"""Queries over whole inputs, against the same results in plain Python."""

import collections
import re

import numpy as np
import pyarrow.parquet as pq

from loam.operators import similar
from loam.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"


def texts():
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def title(text):
    return re.sub(r"[^\W\d_]+", lambda r: (r[0][0].upper().capitalize() + r[0][1:].lower()), text.strip(BLANKS))


def key(name):
    name = name.lower().strip(BLANKS)
    for article in ("the ", "a ", "an "):
        name = name.removeprefix(article)
    name = re.sub(r"[^a-z0-9 ]", "", re.sub(r"\s*\(.*?\)\s*", " ", name, flags=re.ASCII))
    return re.sub(" +", " ", name).strip(" ")


def test_title_case_reaches_the_end_of_every_text(spark):
    want = {k: None if t is None else title(t) for k, t in texts().items()}
    got = {r.doc_id: r.title for r in plans.QUERIES["title_case"](spark, FOLDER).collect()}
    assert any(t and len(t) > 200 for t in got.values()) and got == want


def test_canonical_key_of_whole_texts(spark):
    forms = (" The {} (UN)  x", "A The {}", "An {}", "{}")
    want = {k: None if t is None else key(forms[k % 4].replace("{}", t)) for k, t in texts().items()}
    got = {r.doc_id: r.canon for r in plans.QUERIES["canonical_key"](spark, FOLDER).collect()}
    assert any(t and len(t) > 200 for t in got.values()) and got == want


def brute(rows, asked, k=5):
    out = set()
    for query, _, q in asked:
        groups = collections.defaultdict(list)
        for i, label, v in rows:
            if len(v) == len(q):
                groups[label].append((-round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-9)), 6), i))
        out |= {(query, label, i, rank) for label, g in groups.items() for rank, (_, i) in enumerate(sorted(g)[:k], 1)}
    return out


def test_every_stated_query_searches_all_vectors(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    rows = [(i, label, np.array(v, float)) for i, label, v in zip(*(table[c].to_pylist() for c in ("vec_id", "label", "embedding")), strict=True)]
    asked = [r for r in rows if r[0] % 100 == 0]
    got = plans.QUERIES["topk_cosine"](spark, FOLDER).collect()
    assert len(asked) > 1 and {(r.query, r.label, r.vec_id, r.rank) for r in got} == brute(rows, asked)


def test_search_in_blocks_with_ties_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"l{k % 3}" if k % 7 else None, rng.integers(-1, 2, 3 if k % 11 else 2).astype(float)) for k in range(90)]
    df = spark.createDataFrame([(i, label, v.tolist()) for i, label, v in rows], "id long, label string, v array<double>")
    got = similar.top_pairs(df, df.filter("id % 10 = 0"), "id", "v", "label", block_rows=4).collect()
    assert {(r.query, r.label, r.id, r["rank"]) for r in got} == brute(rows, [r for r in rows if r[0] % 10 == 0])
