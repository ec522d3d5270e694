"""What a streamed batch must not do again and again: sort texts against all ids, shuffle mentions, search a text for its ends."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import extract, resolve
from loam.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_mentions_need_no_shuffle(spark):
    texts = ["Alphaone meets Betatwo and Alphaone", "", "nothing here", "Gammathree", "Epsilon Deltafour, Epsilon Epsilon", None]
    chunks = spark.createDataFrame([(k, j, t) for k, t in enumerate(texts) for j in range(2)], "doc_id long, idx long, text string")
    plain, carried = extract.mentions(chunks), extract.mentions(chunks, after=True)
    assert carried.columns == [*plain.columns, "after"] and sorted(plain.collect()) == sorted(carried.drop("after").collect())
    narrow, dealt = extract.relationships(carried), extract.relationships(plain)
    assert "Exchange" not in _plan(narrow) and "Window" not in _plan(narrow)
    assert sorted(narrow.collect()) == sorted(dealt.collect()) and narrow.count() == 10
    assert sorted(resolve.first_claims(narrow).collect()) == sorted(resolve.first_claims(dealt).collect())


def test_a_chunk_is_searched_for_names_once(spark):
    chunks = spark.createDataFrame([(1, 0, "Alphaone")], "doc_id long, idx long, text string")
    assert _plan(extract.mentions(chunks, after=True)).count("regexp_extract_all") == 1


def test_texts_are_not_dealt_against_all_ids_of_the_store(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"Alphaone number {k} Betatwo", "s") for k in range(40)], "doc_id long, text string, source string")
    again = spark.createDataFrame([(3, "Gammathree", "t"), (100, "Deltafour", "t"), (None, "Epsilon", "t")], docs.schema)
    target = str(tmp_path / "out")
    ingest.absorb(docs, 0, target)
    ingest.absorb(again, 1, target)
    ingest.absorb(again, 1, target)  # replayed
    # only ids that came again are joined to texts
    assert [r.doc_id for r in spark.read.parquet(f"{target}/seen/batch=1").collect()] == [3]
    assert not Path(f"{target}/seen/batch=0").exists()
    kept = sorted((r.doc_id or -1, r.batch) for r in spark.read.parquet(f"{target}/document").collect() if r.batch == 1)
    assert kept == [(-1, 1), (100, 1)]
    assert {r.name for r in ingest.merged_entities(spark, target).collect()} == {"Alphaone", "Betatwo", "Deltafour", "Epsilon"}


def test_ends_are_stripped_as_the_pattern_did(spark):
    rng = random.Random(5)
    blanks = [c for c in map(chr, range(0x10000)) if c.isspace()]
    odd = [*blanks, "​", "᠎", "﻿", "⁠", "\x00", "\x1b", "x", "é", "漢", "😀"]
    texts = [None, "", *blanks, *("".join(rng.choices(odd, k=rng.randint(1, 9))) for _ in range(4000)), *(c + "a" + c + "b" + c for c in odd)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    pattern = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
    wrong = rows.filter(~X.strip(F.col("s")).eqNullSafe(F.regexp_replace("s", rf"^{pattern}+|{pattern}+$", "")))
    assert wrong.collect() == []
    assert "regexp" not in str(X.strip(F.col("s")))
