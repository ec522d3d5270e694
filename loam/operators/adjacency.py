"""The edges of a graph laid out by the node that they are looked up from.

Every edge is stored from both ends in a table that is bucketed by (node, part), so a join with a frontier moves
the frontier alone. A node of more than ``HUB`` edges is split into parts, which lie in several buckets; a frontier
that holds it looks into all of them. Hubs are few: no more than both ends of all edges by ``HUB``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.store import materialize

#: Edges of a node that one part holds, about.
HUB = 100_000
COLUMNS = "u string, v string, source string, type string, target string, evidence string, part int"


def _name(folder: str) -> str:
    return "loam_adjacent_" + hashlib.md5(folder.encode()).hexdigest()[:16]


@dataclass
class Adjacent:
    """``edges``: (u, v, source, type, target, evidence, part), bucketed by (u, part); ``hubs``: (u, parts)."""

    edges: DataFrame
    hubs: DataFrame

    @classmethod
    def store(cls, relation: DataFrame, folder: str, buckets: int | None = None, hub: int = HUB) -> Adjacent:
        """Lay out (source, type, target, evidence) under ``folder``, in as many buckets as a shuffle has partitions."""
        spark = relation.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ends = relation.select("source", "type", "target", "evidence")
        both = ends.select(F.col("source").alias("u"), F.col("target").alias("v"), "*").unionByName(ends.filter("source <> target").select(F.col("target").alias("u"), F.col("source").alias("v"), "*"))
        many = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub)
        hubs = materialize(many.select("u", F.ceil(F.col("n") / hub).cast("int").alias("parts")), folder, "hub")
        rows = both.join(hubs, "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v", "type"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        written = rows.repartition(buckets, "u", "part").write.mode("overwrite").format("parquet").option("compression", "zstd")
        written.bucketBy(buckets, "u", "part").sortBy("u", "part").option("path", f"{folder}/edges").saveAsTable(_name(folder))
        materialize(spark.createDataFrame([(buckets,)], "buckets int"), folder, "layout")
        return cls.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Adjacent:
        """The layout under ``folder``; a session that did not write it is told of its buckets first."""
        if not spark.catalog.tableExists(_name(folder)):
            buckets = spark.read.parquet(f"{folder}/layout").first().buckets
            spark.sql(f"create table {_name(folder)} ({COLUMNS}) using parquet clustered by (u, part) sorted by (u, part) into {buckets} buckets location '{folder}/edges'")
        return cls(spark.table(_name(folder)), spark.read.schema("u string, parts int").parquet(f"{folder}/hub"))

    def of(self, names: DataFrame) -> DataFrame:
        """The columns of ``names`` (name, ..) with each edge (v, source, type, target, evidence) of the node."""
        hubs = self.hubs.select(F.col("u").alias("loam_hub"), "parts")
        asked = names.join(hubs, F.col("name") == F.col("loam_hub"), "left").withColumn("loam_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = asked.join(self.edges, (F.col("name") == F.col("u")) & (F.col("loam_part") == F.col("part")))
        return met.drop("u", "part", "parts", "loam_hub", "loam_part")
