"""Hard negatives against brute force in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loam.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k_pos=5, k_neg=5, low=80, high=100):
    ok = []
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if sum(x * x for x in whole) < 2**62:
            ok.append((i, whole, y))
    out = []
    for i, v, y in ok:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in ok if j != i and len(w) == len(v)]
        first = sorted((-s, j) for s, j, z in scored if z == y)[:k_pos]
        for minus, p in first:
            window = sorted((-s, j) for s, j, z in scored if z != y and low * -minus <= 100 * s <= high * -minus)[:k_neg]
            out += [(i, p, r, j, -minus, -s) for r, (s, j) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    # a column of the name of an inner one, which is not read
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"blk": F.lit("x"), "anchor": F.lit(1)})
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 100 == 0, **kw).collect())


def made(n, seed=1, dim=6, step=None):
    rng = random.Random(seed)
    draw = lambda: rng.gauss(0.2, 0.5) if step is None else rng.randrange(-3, 4) * step
    return [(i, [draw() for _ in range(dim)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("block_rows", [None, 37])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_rows):
    rows = made(600)
    assert mined(spark, rows, block_rows=block_rows) == brute(rows)


def test_ties_go_to_smaller_ids_across_blocks(spark):
    rows = made(500, 2, 3, 0.25)  # few different vectors: nearly all scores are tied
    assert len({s for *_, s in brute(rows)}) < 60
    assert mined(spark, rows, block_rows=29) == brute(rows)


def test_odd_rows_take_no_part(spark):
    bad = [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1), (500, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (600, [], 1), (700, [1e40, 0.0], 1), (800, [1.0, 1.0, 1.0], 1)]
    rows = bad + made(130, 3, 2)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, bad) == [] and mined(spark, []) == []


def test_scores_over_2_to_53_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(4e5, 8e5) + i for _ in range(4)], i % 2) for i in range(220)]
    out = mined(spark, rows)
    assert out == brute(rows) and max(s for *_, s in out) > 2**53


def test_a_hot_label_and_windows_without_rows(spark):
    rows = [(i, v, 0) for i, v, _ in made(300, 5)]
    assert mined(spark, rows, block_rows=50) == []  # one label: no negatives
    rows = [(i, [-1.0, 0.0], 0) if i % 2 else (i, [1.0, 0.0], 0) for i in range(101)] + [(1000 + i, [0.9, 0.3], 1) for i in range(8)]
    assert mined(spark, rows) == brute(rows)
