"""Collocations against counting everything."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from loam.llm import phrases

UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(rows, least=10, most_words=3, top=2000, covered=50):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = []
    for lang in n:
        best = []
        for (own, p), a in found.items():
            if own != lang:
                continue
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(o == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), b in found.items())
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"word": F.lit("x"), "n": F.lit(1), "phrase": F.lit(None)})
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "ÉA", "日本", "x-1", "<b>", " z"] + [f"w{k}" for k in range(12)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 14 + ["\t", "  ", ", ", ".", "\n", "\x0b", "\r\n", "!?"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_equals_counting_everything(spark, most_words):
    rows = [*made(300), (None, "en"), ("", "en"), (" . \n", "de"), ("one two", "it")] + [("same words again and again", "fr")] * 12
    assert mined(spark, rows, most_words=most_words) == brute(rows, most_words=most_words)


def test_slices_and_portions_change_nothing(spark, monkeypatch):
    rows = made(300, 2)
    monkeypatch.setattr(phrases, "SLICE", 500)
    assert mined(spark, rows, held_bytes=200) == brute(rows)  # nearly every prefix is counted in portions


def test_hot_words_ties_and_the_cut_at_the_top(spark):
    rows = [("hot " * 400 + "a b a b", "en")] * 11 + [(f"t{k} u{k}", "en") for k in range(30)] * 10
    full = brute(rows)
    assert mined(spark, rows) == full and len({r[7] for r in full}) < len(full)
    assert mined(spark, rows, top=7) == brute(rows, top=7)


def test_a_long_text_and_no_rows(spark):
    rows = [(" ".join(random.Random(3).choice("abcdef") for _ in range(60000)), "en")]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
