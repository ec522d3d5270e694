"""Structured Streaming: documents into a store that grows, and call rates with late data.

The store keeps what each batch knows of an entity or edge, never a merged row: least and largest places and lengths merge in
any order, so batches give what one build over all documents gives, and a batch writes as much as it holds itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.operators import extract, resolve


def _read(spark: SparkSession, target: str, table: str) -> DataFrame:
    return spark.read.option("basePath", f"{target}/{table}").parquet(f"{target}/{table}/batch=*")


def _seen(batch: DataFrame, number: int, target: str) -> DataFrame | None:
    """(doc_id) of the batch's documents that another batch holds; None before there are any."""
    spark = batch.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/document")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    known = _read(spark, target, "document").filter(F.col("batch") != number).select("doc_id")
    return known.join(batch.select("doc_id"), "doc_id", "left_semi")


def absorb(batch: DataFrame, number: int, target: str) -> None:
    """A batch of documents (doc_id, text, source) as its share of every table of the store: documents, chunks, mentions, and
    what it knows of each entity and edge. A batch that is replayed under its number overwrites itself; the
    shares of earlier batches are not touched. A null or empty text has no share but its document. Documents are dealt out anew,
    as a file that comes is often one row group, which one task reads. One that comes again keeps its first text; the ids of those
    are written first, so that texts are not sorted and dealt against all ids of a store that grows."""
    spark = batch.sparkSession

    def put(df: DataFrame, table: str) -> DataFrame:
        path = f"{target}/{table}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    seen = _seen(batch, number, target)
    fresh = batch if seen is None else batch.join(put(seen, "seen"), "doc_id", "left_anti")
    chunks = put(extract.chunk(fresh.repartition("doc_id", "text")), "chunk")
    found = put(extract.mentions(chunks, after=True), "mention")
    put(resolve.entity_shares(found), "entity")
    put(resolve.first_claims(extract.relationships(found)), "claim")
    put(fresh.select("doc_id", "source", F.length("text").cast("long").alias("n_chars")), "document")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """New files of documents go into the store ``target``, at most ``files`` in a batch."""
    stream = spark.readStream.schema(schema)
    stream = (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, number: absorb(batch, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_entities(spark: SparkSession, target: str) -> DataFrame:
    """Entities over all batches, as one build over all documents merges them."""
    return resolve.merged_shares(_read(spark, target, "entity"))


def merged_relations(spark: SparkSession, target: str, entities: DataFrame | None = None) -> DataFrame:
    """Edges (source, type, target, evidence) over all batches, as one build over all documents stores them: names are
    given when read, so a longer name that comes later renames the edges of all batches before."""
    entities = merged_entities(spark, target) if entities is None else entities
    claims = _read(spark, target, "claim").drop("batch")
    return resolve.ingest_edges(resolve.clean_relationships(claims, entities), resolve.upserted(entities))


def call_rates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls a minute of each user, for a stream or a table; later events than ``late`` are let go."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("minute"), "user_id", "calls")
