"""Evaluation: judge replies, similarity metrics, roll-ups and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.functions import vector as V

METRICS = ("answer_relevancy", "faithfulness", "context_recall", "avg_relevance_score")


def judge_score(reply: Column, items: str = "claims", flag: str = "supported") -> Column:
    """A judge's score: its own, clamped, else the share of items that carry the flag, else 0."""
    body = X.reply_json(reply)
    parsed = F.from_json(body, f"score string, {items} array<struct<{flag}:boolean>>")
    rows = parsed[items]
    share = F.size(F.filter(rows, lambda x: F.coalesce(x[flag], F.lit(False)))) / F.size(rows)
    own = parsed["score"].try_cast("double")
    score = F.when(own.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), own))).when(F.size(rows) > 0, share)
    return F.coalesce(score, F.lit(0.0))


def contained_score(claims: Column, context: Column) -> Column:
    """The offline judge: the share of a text's words (over three letters) that the context holds."""
    words = F.array_distinct(F.filter(V.words(claims), lambda w: F.length(w) > 3))
    known = V.words(context)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, known)) / F.size(words)).otherwise(0.0)


def answer_relevancy(query: Column, answer: Column) -> Column:
    return F.bround(V.cosine(query, answer), 4)


def average_relevance(pairs: DataFrame, key: str = "qid", similarity: str = "similarity") -> DataFrame:
    return pairs.groupBy(key).agg(F.bround(F.avg(similarity), 4).alias("avg_relevance_score"), F.count(F.lit(1)).alias("n_chunks"))


def roll_up(rows: DataFrame, category: str = "category", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(category, n, metric means): by category and overall, rounded half-even."""
    means = [F.bround(F.avg(m), 4).alias(m) for m in metrics]
    return rows.groupingSets([[category], []], category).agg(F.count(F.lit(1)).alias("n"), *means).withColumn(category, F.coalesce(category, F.lit("overall")))


def compare(a: DataFrame, b: DataFrame, key: str = "category", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(key, metric, baseline, graph, delta, better): both sides aligned, missing values 0."""
    tidy = lambda df, name: df.unpivot([key], list(metrics), "metric", name)
    rows = tidy(a, "baseline").join(tidy(b, "graph"), [key, "metric"], "full_outer").na.fill(0.0, ["baseline", "graph"])
    return rows.withColumn("delta", F.round(F.col("graph") - F.col("baseline"), 4)).withColumn("better", F.col("delta") > 0)
