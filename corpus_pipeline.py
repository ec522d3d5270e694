"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last one:
token ids). Its result is written as Parquet, and the next stage reads that: a lost executor
costs a stage's tasks at most.

Defined results: null and empty texts fail the quality rules and go, so no later stage meets them
in a run (alone, every stage takes them as its operator does); repeated rows are copies and one
stays; a null doc_id or source stays null; an empty table gives an empty result; columns other than
those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard, mixing, pieces, pii, rules
from loam.llm.queries import piece_model
from loam.llm.store import materialize, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep (operator 10)."""
    learned = rules.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(rules.keeps(F.col("text"), learned))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 5): the one with the smallest doc_id.

    A row without a doc_id goes by a hash of its text. Of rows that share a doc_id though their
    texts differ, those of the smallest text hash keep it and the others go by a hash of both.
    Of rows alike in doc_id and text the one whose values come first stays.
    """
    keyed = docs.withColumns({"loam_text": F.xxhash64("text"), "loam_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))})
    clash = keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("loam_text").alias("loam_first"), F.max("loam_text").alias("loam_last")).filter("loam_first < loam_last")
    if not clash.isEmpty():
        keyed = keyed.join(clash.drop("loam_last"), "doc_id", "left")
        keyed = keyed.withColumn("loam_id", F.when(F.col("loam_text") > F.col("loam_first"), F.xxhash64("doc_id", "loam_text")).otherwise(F.col("loam_id")))
    groups = jaccard.near_duplicates(keyed.select(F.col("loam_id").alias("doc_id"), "text"))
    kept = groups.filter("kept").select(F.col("doc_id").alias("loam_id"))
    # merged at every size: whether the ids fit a broadcast must not decide how this grows
    one = keyed.join(kept.hint("merge"), "loam_id", "left_semi").groupBy("loam_id").agg(F.min(F.struct(*docs.columns)).alias("loam_row"))
    return one.select("loam_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kinds (operator 3)."""
    masked = pii.redact(docs, pii.fit_from(docs.select("doc_id", "text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order (operator 8)."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("loam_row"))
    mixed = mixing.mix(packed, carry=("loam_row",))
    return mixing.sequence(mixed.filter("copies > 0")).select("loam_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with their source bytes, after a check that they decode to the text (operator 7)."""
    encoded = pieces.encode(docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text"), piece_model())
    return encoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.element_at("ends", -1).cast("long").alias("spanned_bytes"),
        (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Learned rules and models decide here, so SQL cannot say it; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
