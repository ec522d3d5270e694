"""The flat pipeline: vector chunks, widened by the chunks of entities that a question mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.operators.within import holding


def terms(index: DataFrame) -> DataFrame:
    """(key, term): what may stand in a question for an entity: its key, or a word of it over three letters."""
    words = F.filter(F.split("key", r"\s+"), lambda w: F.length(w) > 3)
    return index.select("key", F.explode(F.array_union(F.array("key"), words)).alias("term")).filter("term <> ''")


def mentioned(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, key, name): entities of which a term stands in the question as a substring."""
    lower = questions.select("qid", F.lower("query").alias("loam_query"))
    hits = holding(lower, "loam_query", terms(index), "term").select("qid", "key").distinct()
    return hits.join(index.select("key", "name"), "key").select("qid", "key", "name")


def _first(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The rows at the first ``k`` places of each key, all of a place that comes again. The first ``k`` places of several keys
    taken together are among these, so what a common name adds to a question doesn't grow with the table."""
    return rows.withColumn("loam_place", F.dense_rank().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("loam_place") <= k).drop("loam_place")


def merged_context(vector: DataFrame, matched: DataFrame, postings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(qid, chunk_id, phase, place): vector chunks by rank, then entity chunks by (doc_id, idx)."""
    cap = config.flat_top_k + config.flat_extra_chunks
    own = vector.select("qid", "chunk_id", F.lit(0).alias("phase"), F.col("rank").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"))
    # a vector chunk that is passed over has a place of its own before, so ``cap`` places are enough
    rows = matched.select("qid", "key").join(_first(postings, "key", ["doc_id", "idx"], cap), "key").select("qid", "doc_id", "idx").distinct()
    rows = rows.select("qid", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")).alias("chunk_id"), F.lit(1).alias("phase"), F.col("doc_id").alias("o1"), F.col("idx").cast("long").alias("o2"))
    rows = rows.join(own.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("phase", "o1", "o2")
    return own.unionByName(rows).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).select("qid", "chunk_id", "phase", "place")


def matched_relationships(matched: DataFrame, relationships: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(qid, place, source, target, type): the first raw relationships with an end among the names."""
    names = matched.select("qid", F.lower("name").alias("n")).distinct()
    rows = relationships.withColumns({"s": F.lower("source"), "t": F.lower("target")})
    place = ["doc_id", "idx", "pos", "source", "target", "type"]
    s, t = (_first(rows, end, place, config.flat_relationships) for end in ("s", "t"))
    either = s.join(names, F.col("s") == F.col("n")).unionByName(t.join(names, F.col("t") == F.col("n")))
    either = either.select("qid", "doc_id", "idx", "pos", "source", "target", "type").distinct()
    order = Window.partitionBy("qid").orderBy("doc_id", "idx", "pos")
    return either.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config.flat_relationships).select("qid", "place", "source", "target", "type")
