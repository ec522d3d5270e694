"""String semantics against plain Python."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.functions import vector as V
from loam.plans import queries as plans


def apply(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


@pytest.mark.parametrize("length,expected", [(0, 0), (1, 1), (1350, 1), (1351, 2), (1500, 2), (2700, 2), (23397, 18)])
def test_chunk_counts(spark, length, expected):
    (chunks,) = apply(spark, X.chunks, ["x" * length])
    assert len(chunks) == expected


def test_blank_chunks_fall_away(spark):
    assert apply(spark, X.chunks, [" \n" * 2000]) == [[]]


def test_chunk_size_must_exceed_overlap():
    with pytest.raises(ValueError):
        X.windows(F.lit("x"), 10, 10)


def test_title(spark):
    names = ["mediscan-c o'neil NOVACARE (tlv)", "éCOLE de l'été", "ßachein x", "a1b2", ""]
    assert apply(spark, X.title, names) == [n.title() for n in names]


def test_canonical_key(spark):
    names = ["the Paris Agreement (2015)", "A The X", "United  Nations (UN) x", "École", "", "an  Apple."]
    assert apply(spark, X.canonical_key, names) == ["paris agreement", "the x", "united nations x", "cole", "", "apple"]


def test_better_description(spark):
    pairs = [("", "b"), ("a", ""), ("cat", "A Cat sat"), ("A Cat sat", "cat"), ("abc", "xyz"), ("ab", "xyz")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r.o for r in rows.select("k", X.better_description(F.col("a"), F.col("b")).alias("o")).orderBy("k").collect()]
    assert got == ["b", "a", "A Cat sat", "A Cat sat", "abc", "xyz"]


def test_reply_json(spark):
    replies = ['x ```json\n{"a": 1}\n``` y', '{"a": 1}', 'so: [{"a": 1}] ok', "broken {", "", 'p {"a": 1} q', "```\n[1]\n```"]
    got = apply(spark, X.reply_json, replies)
    assert [json.loads(x) for x in got] == [{"a": 1}, {"a": 1}, [{"a": 1}], {}, {}, {"a": 1}, [1]]


def test_strip_think_and_source(spark):
    assert apply(spark, X.strip_think, ["<think>a\nb</think>\n ok <think></think>"]) == ["ok"]
    texts = ["\n(a long bracket line)\nThis is the title\nmore", "short\nx\ny\nA line too late to count", ""]
    assert apply(spark, X.detected_source, texts) == ["This is the title", "unknown", "unknown"]


def test_relation_type(spark):
    assert apply(spark, X.relation_type, ["led to", "", None, "é-x"]) == ["LED_TO", "RELATED_TO", "RELATED_TO", "__X"]


def test_clamp_and_bar(spark):
    assert apply(spark, X.clamp, ["2", "-1", "0.5"]) == [1.0, 0.0, 0.5]
    assert apply(spark, lambda v: X.bar(v.cast("double"), 10), ["0.55"]) == ["#####....."]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab T\t\n(é)the", max_size=30), min_size=1, max_size=5))
def test_strip_is_pythons(spark, values):
    assert apply(spark, X.strip, values) == [v.strip() for v in values]


def test_embedding_counts_words(spark):
    rows = V.embed(spark.createDataFrame([(1, "The cat, the CAT!"), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("k").collect()
    assert [sum(r.embedding) for r in rows] == [4.0, 0.0, 0.0]
    assert max(rows[0].embedding) == 2.0 and len(rows[0].embedding) == V.DIM
    assert re.fullmatch("[0-9.]+", str(rows[0].embedding[0]))


def test_rounding_is_that_of_sql(spark):
    values = [-1e-9, -0.0, 0.0, 2.5e-6, -0.1234565, 4.999999999999999e-7, 1e300, float("inf"), 0.1, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", V.rounded(F.col("x"), 6).alias("r"))
    want = [-0.0, -0.0, 0.0, 3e-6, -0.123457, 0.0, 1e300, float("inf"), 0.1, None]
    assert [repr(r.r) for r in rows.orderBy("k").collect()] == [repr(x) for x in want]  # a small negative number is -0.0, not 0.0


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    spark.createDataFrame([(1, [-1e-8, 3.0, 4.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert repr(plans.QUERIES["l2_normalise"](spark, str(tmp_path)).first().unit) == "[-0.0, 0.6, 0.8]"
