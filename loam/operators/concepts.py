"""Concepts over entities: drafting, resolving members, and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT
from loam.operators.resolve import numbered
from loam.operators.within import holding

MEMBERS = 6


def draft_batches(entities: DataFrame, folder: str, per_batch: int = DEFAULT.concept_batch) -> DataFrame:
    """(concept, member, place): every merged entity, in batches of ``per_batch`` in entity order,
    as they are put to a model. The offline stand-in for the reply: runs of two to six
    neighbours, each sharing its last member with the next run of the batch.

    Every entity is in one concept or two; a batch of one alone makes a concept of one member, which
    falls away like any other.
    """
    step = MEMBERS - 1
    rows = numbered(entities, folder).select("name", F.floor(F.col("n") / per_batch).alias("batch"), (F.col("n") % per_batch).alias("k"))
    own = F.floor(F.col("k") / step)
    runs = F.when((F.col("k") > 0) & (F.col("k") % step == 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = rows.withColumn("run", F.explode(runs)).withColumn("place", (F.col("k") - F.col("run") * step + 1).cast("int"))
    # a last entity that only closes the run before it opens none of its own
    size = F.count(F.lit(1)).over(Window.partitionBy("batch", "run"))
    rows = rows.withColumn("size", size).filter("size > 1 or run = 0")
    return rows.select(F.format_string("Theme %d.%d", F.col("batch") + 1, F.col("run") + 1).alias("concept"), F.col("name").alias("member"), "place")


def resolve_members(drafts: DataFrame, entities: DataFrame) -> DataFrame:
    """(concept, entity): members found by exact name, else by lower case, else the smallest name
    that contains the member or is contained in it; concepts of one member fall away."""
    names = entities.select(F.col("name").alias("entity")).distinct()
    exact = drafts.join(names, F.col("member") == F.col("entity"), "left")
    lower = names.groupBy(F.lower("entity").alias("key")).agg(F.min("entity").alias("by_lower"))
    rows = exact.join(lower, F.lower(F.trim("member")) == F.col("key"), "left").withColumn("entity", F.coalesce("entity", "by_lower"))
    open_ = rows.filter("entity is null").select("concept", "member").distinct()
    open_ = open_.withColumn("m", F.lower("member"))
    near = names.select(F.col("entity").alias("near"), F.lower("entity").alias("n"))
    inside = holding(open_, "m", near, "n").unionByName(holding(near, "n", open_, "m"))  # either holds the other
    loose = inside.groupBy("concept", "member").agg(F.min("near").alias("entity"))
    found = rows.filter("entity is not null").select("concept", "entity").unionByName(loose.select("concept", "entity")).distinct()
    enough = found.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("concept")
    return found.join(enough, "concept", "left_semi")


def overlap(members: DataFrame) -> DataFrame:
    """(a, b, weight): concepts that share members, by an equi-join on the member."""
    rows = members.select("concept", F.lower("entity").alias("m")).distinct()
    left, right = rows.select(F.col("concept").alias("a"), "m"), rows.select(F.col("concept").alias("b"), "m")
    return left.join(right, "m").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def entity_prompt(entities: DataFrame, folder: str, budget: int = DEFAULT.entity_text_chars, per_batch: int = DEFAULT.concept_batch) -> DataFrame:
    """(batch, n_entities, listing): lines of all entities, in batches in entity order, each cut
    before the first line over budget."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.coalesce("type", F.lit("OTHER")), F.lit("]: "), F.substring(F.coalesce("description", F.lit("")), 1, DEFAULT.entity_description_chars))
    rows = numbered(entities, folder).select(F.col("n").alias("place"), F.floor(F.col("n") / per_batch).alias("batch"), line.alias("line"))
    run = Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("line") + 1).over(run), F.lit(0)))
    over = F.min(F.when(F.col("used") + F.length("line") > budget, F.col("place"))).over(Window.partitionBy("batch"))
    rows = rows.withColumn("cut", over).filter("cut is null or place < cut")
    listing = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x.line), "\n")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n_entities"), listing.alias("listing"))
