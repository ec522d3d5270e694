"""Mixing sources to target weights under a time-varying curriculum, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; each gets its share
of all words, stops at three times its own size, and the excess is shared again by weight
(water filling, solved in closed form over the sources sorted by size per weight).

Taken words: the documents of a source stand in hash order; a source with target T and size S
takes every document floor(T / S) times and the documents whose middle lies in the first
T mod S words once more. So only whole documents are taken, none over three times.

Curriculum: source s has weight w_s(t) = 1 + tilt_s * (2t - 1) over training time t in [0, 1],
with the tilt falling from +TILT for the first source to -TILT for the last. Its integral
W_s(t) = t + tilt_s * (t * t - t) is the part of s that training has read by t. A copy whose
middle is at part u of its source's demand is placed at t = W_s^-1(u), the root of a quadratic.
By then training has read sum_s T_s W_s(t) words of all sources: that is the copy's offset in the
mixed sequence, which is sorted with a range partitioning.

Running sums over a source would put a hot source into one task, so they are made in two steps:
sums per (source, hash bucket), a running sum over buckets, and one inside each bucket. The
number of buckets grows with the table. Ties in the hash are broken by doc_id, then text. Words are
counted in one scan, whose result is written.

Defined results: null text has size 0 and is taken 0 words; a source of size 0 has target 0;
null doc_id sorts first in its bucket; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.store import materialize, workspace

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
TILT = 0.5
BUCKET_ROWS = 500


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets and tilts from a table (mix_source, source, source_size) of one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("level").asc(), F.col("place").asc())
    everyone = Window.partitionBy(F.lit(1))
    out = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1))
    out = out.withColumn("cap", MAX_EPOCHS * F.col("source_size")).withColumn("level", F.col("cap").cast("double") / F.col("weight"))
    out = out.withColumns({"total": F.sum("source_size").over(everyone), "n_sources": F.count(F.lit(1)).over(everyone)})
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    # the first source whose level is above its share and all after it get weight * share
    out = out.withColumn("water", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "place", "share"))).over(everyone))
    open_ = F.col("water").isNotNull() & ((F.col("level") > F.col("water.level")) | ((F.col("level") == F.col("water.level")) & (F.col("place") >= F.col("water.place"))))
    out = out.withColumn("target", F.when(open_, F.least(F.col("weight") * F.col("water.share"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")))
    tilt = TILT * (1 - 2 * F.col("place") / F.greatest(F.col("n_sources") - 1, F.lit(1)))
    out = out.withColumn("tilt", tilt.cast("double"))
    # words that training has read by t: steady * t + rising * t * t
    out = out.withColumns({"steady": F.sum(F.col("target") * (1 - F.col("tilt"))).over(everyone), "rising": F.sum(F.col("target") * F.col("tilt")).over(everyone)})
    return out.select("mix_source", "source", "source_size", "target", "tilt", "steady", "rising")


def _sizes(df: DataFrame, kept: list[str]) -> DataFrame:
    """One scan: the kept columns, the size in words, and the keys that place a row."""
    return df.select(
        *kept,
        word_count(F.col("text")).alias("mix_size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mix_key"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("mix_source"),
        F.xxhash64("text").alias("mix_tie"),
    )


def mix(df: DataFrame, rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies, first_position and
    first_token, positions (times in training, one a copy), tokens (word offsets in the mixed
    sequence) and the ``carry`` columns.

    ``rows``: about how many rows ``df`` has, counted here if not given; it sets the buckets.
    """
    kept = list(dict.fromkeys(["doc_id", "source", *carry]))
    base = materialize(_sizes(df, kept), workspace(df.sparkSession, "mixing"), "sizes")
    buckets = max(1, (base.count() if rows is None else rows) // BUCKET_ROWS)
    place = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)
    base = base.withColumn("mix_bucket", F.floor(place).cast("long"))
    sums = base.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("bucket_size"), F.first("source").alias("source"))
    targets = source_targets(sums.groupBy("mix_source").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source")))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.drop("source").join(targets.drop("source"), "mix_source").select("mix_source", "mix_bucket", "bucket_start", "source_size", "target", "tilt", "steady", "rising")
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", F.col("doc_id").asc_nulls_first(), "mix_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("inner", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    placed = placed.join(starts.hint("merge"), ["mix_source", "mix_bucket"])  # dealt so already; the buckets grow with the table
    size, whole = F.col("mix_size"), F.greatest(F.col("source_size"), F.lit(1))
    middle = F.col("bucket_start") + F.col("inner") + size / 2.0
    epochs = F.floor(F.col("target") / whole)
    part = F.col("target") - epochs * whole
    copies = F.when(size == 0, F.lit(0)).otherwise(epochs + F.when(middle < part, 1).otherwise(0)).cast("long")
    out = placed.withColumns({"middle": middle, "copies": copies})
    # part of the source's demand at which copy k (from 0) has its middle
    demand = F.greatest(F.col("target"), F.lit(1.0))
    at = lambda k: F.least((k * F.col("source_size") + F.col("middle")) / demand, F.lit(1.0))
    a, b = F.col("tilt"), 1 - F.col("tilt")
    root = lambda u: F.when(F.abs(a) < 1e-12, u).otherwise((F.sqrt(b * b + 4 * a * u) - b) / (2 * a))
    times = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)), lambda k: F.round(root(at(k)), 12))
    out = out.withColumn("mix_times", times)  # apart from the select below, whose aliases would shadow its inputs
    out = out.withColumn("mix_tokens", F.transform("mix_times", lambda t: F.round(F.col("steady") * t + F.col("rising") * t * t, 3)))
    return out.select(
        *kept,
        size.alias("size"),
        "source_size",
        F.round("target", 6).alias("target"),
        (size * F.col("copies")).alias("taken"),
        "copies",
        F.col("mix_times").alias("positions"),
        F.col("mix_tokens").alias("tokens"),
        F.try_element_at("mix_times", F.lit(1)).alias("first_position"),
        F.try_element_at("mix_tokens", F.lit(1)).alias("first_token"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows sorted by the position of their first copy; documents not taken come last."""
    return mixed.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def sequence(mixed: DataFrame) -> DataFrame:
    """One row a copy, range-sorted by its ``position`` in training; ``token``: words read before its middle."""
    each = mixed.withColumn("mix_at", F.explode(F.arrays_zip(F.col("positions").alias("position"), F.col("tokens").alias("token"))))
    return each.withColumns({"position": F.col("mix_at.position"), "token": F.col("mix_at.token")}).drop("mix_at").orderBy("position", "doc_id")
