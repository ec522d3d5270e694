"""Tables cut from their lineage, written where every executor sees them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is
unset and the master is local (tests), a temporary folder of this machine serves; on
a cluster without the setting this raises, since executors share no local folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loam-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone; nothing else is at stake here
            return


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lost executors recompute from files."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, order: list[str], size: Column, folder: str, name: str = "placed") -> DataFrame:
    """``rows`` in the given order with ``before``, the sum of ``size`` of all rows before: running sums within the
    written parts of a range sort, plus the sums of the parts before. No task gets all rows."""
    at = F.monotonically_increasing_id()
    rows = materialize(rows.orderBy(*order).withColumns({"loam_at": at, "loam_size": size.cast("long")}), folder, name)
    rows = rows.withColumn("loam_part", F.shiftright("loam_at", 33))
    own = Window.partitionBy("loam_part").orderBy("loam_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("loam_own", F.coalesce(F.sum("loam_size").over(own), F.lit(0)))
    parts = rows.groupBy("loam_part").agg(F.sum("loam_size").alias("loam_sum"))
    ahead = F.sum("loam_sum").over(Window.orderBy("loam_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("loam_part", F.coalesce(ahead, F.lit(0)).alias("loam_ahead"))
    return rows.join(parts, "loam_part").withColumn("before", F.col("loam_ahead") + F.col("loam_own")).drop("loam_part", "loam_at", "loam_size", "loam_own", "loam_ahead")


def numbered(rows: DataFrame, order: list[str], folder: str, name: str = "numbered") -> DataFrame:
    """``rows`` with their number ``n`` from 0 in the given order: places within the written parts of
    a range sort, plus the rows of the parts before. No task gets all rows."""
    at = F.monotonically_increasing_id()
    rows = materialize(rows.orderBy(*order).withColumn("loam_at", at), folder, name)
    rows = rows.withColumns({"loam_part": F.shiftright("loam_at", 33), "loam_k": F.col("loam_at").bitwiseAND((1 << 33) - 1)})
    parts = rows.groupBy("loam_part").agg(F.count(F.lit(1)).alias("loam_rows"))
    before = F.sum("loam_rows").over(Window.orderBy("loam_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("loam_part", F.coalesce(before, F.lit(0)).alias("loam_before"))
    return rows.join(parts, "loam_part").withColumn("n", F.col("loam_before") + F.col("loam_k")).drop("loam_part", "loam_at", "loam_k", "loam_before")
