"""Bounded samples to learn from: the rows with the smallest hashes, found in two scans.

The first scan counts, the second keeps the rows whose hash is under a share of the hash space
that holds the sample with a margin of six deviations, so tasks send a bounded number of rows in
all, whatever the table and however many tasks read it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that a sample is taken from at most; a model of more classes than this is refused.
MOST_GROUPS = 1000


def _share(n: int, count: int) -> float:
    return min(1.0, (n + 6 * math.sqrt(n) + 50) / max(1, count))


def smallest(rows: DataFrame, keys: list[str], n: int, by: str | None = None) -> DataFrame:
    """The ``n`` rows (of each value of ``by``) with the smallest hash of ``keys``; rows alike in
    hash and group count once, the one whose values come first stands for them."""
    spark = rows.sparkSession
    if by is None:
        counts = {None: rows.count()}
    else:
        counts = {r[0]: r[1] for r in rows.groupBy(by).count().limit(MOST_GROUPS + 1).collect()}
        if len(counts) > MOST_GROUPS:
            raise ValueError(f"over {MOST_GROUPS} values of {by}")
    if not any(counts.values()):
        return spark.createDataFrame([], rows.schema)
    shares = {k: _share(n, c) for k, c in counts.items()}
    share: Column = F.lit(shares[None]) if by is None else F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(by)]
    hashed = rows.withColumn("loam_hash", F.xxhash64(*keys))
    few = hashed.filter(F.shiftrightunsigned("loam_hash", 1) / float(1 << 63) < share)
    group = ["loam_hash", *([by] if by else [])]
    one = few.groupBy(*group).agg(F.min(F.struct(*rows.columns)).alias("loam_row")).select(*group, "loam_row")
    if by is None:
        return one.orderBy("loam_hash").limit(n).select("loam_row.*")
    place = F.row_number().over(Window.partitionBy(by).orderBy("loam_hash"))
    return one.withColumn("loam_place", place).filter(F.col("loam_place") <= n).select("loam_row.*")
