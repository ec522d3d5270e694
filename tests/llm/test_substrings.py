"""Repeated substrings against looking up every run of bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import substrings, textkit


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).hexdigest(), k))
    seen, out = set(), []
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            run = raw[p : p + length]
            if run in seen:
                gone[p : p + length] = True
            seen.add(run)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((rows[k][0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(spark, rows, length, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit("x"), "spans": F.lit(1), "place": F.lit(0)}).repartition(3)
    out = substrings.deduplicate(df, length, **kw).collect()
    for r in out:
        assert r.n_bytes - r.n_removed == len(r.text) and hashlib.sha256(r.text).hexdigest() == r.kept_sha256
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)


def made(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(12)]
    rows = [(900, None), (901, ""), (902, "short"), (903, "x" * 400), (904, "xy" * 150 + "x" * 99)]
    for k in range(n):
        parts = [rng.choice([rng.choice(shared), " ".join(word() for _ in range(rng.randrange(1, 40)))]) for _ in range(rng.randrange(1, 6))]
        text = "".join(parts)
        if rng.random() < 0.5:  # a near copy
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((k, text))
    rows += [(2000 + k, rows[10 + k % 3][1]) for k in range(9)]  # exact copies
    return rows


@pytest.mark.parametrize("length", [1, 7, 24, 100])
def test_equals_looking_up_every_run(spark, length):
    rows = made(60)
    assert cut(spark, rows, length) == brute(rows, length)


def test_small_buckets_and_slices_change_nothing(spark, monkeypatch):
    rows = made(60, 2)
    monkeypatch.setattr(substrings, "SLICE", 300)
    monkeypatch.setattr(substrings, "STRETCH", 150)
    assert cut(spark, rows, 40, held_bytes=600) == brute(rows, 40)  # hot stretches are cut and compared across


def test_ids_that_are_null_or_repeat(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(150)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1] + texts[2]), (5, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[3]), (4, texts[3] + texts[0][:120])]
    assert cut(spark, rows, 100) == brute(rows, 100)


def test_a_passage_in_every_text_and_no_rows(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(k, "".join(rng.choice("klmnop ") for _ in range(rng.randrange(80))) + passage + str(k)) for k in range(300)]
    out = cut(spark, rows, 100, held_bytes=3000)
    assert out == brute(rows, 100) and sum(r[2] >= 260 for r in out) == 299
    assert cut(spark, [], 100) == []


def test_a_text_of_repeated_bytes(spark):
    rows = [(1, "a" * 60000 + "b"), (2, "ab" * 3000), (3, "c" + "a" * 500)]
    assert cut(spark, rows, 100) == brute(rows, 100)


def test_multikey_ranks_are_those_of_sorting():
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"ab\x00\xff") for _ in range(4000)), np.uint8)
    for size in (1, 7, 8, 9, 31):
        start = np.array([rng.randrange(4000 - size) for _ in range(900)])
        cls = np.array([rng.randrange(2) for _ in range(900)])
        rank = substrings.multikey(data, start, np.full(900, size), cls)
        keys = [(c, data[s : s + size].tobytes()) for c, s in zip(cls, start, strict=True)]
        first = {k: i for i, k in reversed(list(enumerate(sorted(keys))))}
        assert rank.tolist() == [first[k] for k in keys]


def test_anchors_depend_on_the_run_alone():
    rng = random.Random(6)
    inner = bytes(rng.choice(b"abc") for _ in range(500))
    for length in (30, 100):
        found = set()
        for before in (0, 1, 57):
            raw = bytes(rng.choice(b"abc") for _ in range(before)) + inner + b"zz"
            _, at, first, last = substrings.anchored(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length)
            serves = {p: a for a, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True) for p in range(f, e + 1)}
            assert sorted(serves) == list(range(len(raw) - length + 1))
            found.add(tuple(serves[p] - p for p in range(before, before + 500 - length + 1)))
        assert len(found) == 1
    data, at = textkit.string_bytes(__import__("pyarrow").array(["", "ab"]))
    assert len(substrings.anchored(data, at, 100)[0]) == 0
