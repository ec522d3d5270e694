"""Communities of concepts: connected components, modularity, scores and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators.leiden import FEW, leiden, reach
from loam.store import materialize, numbered


def _one_group(concepts: DataFrame) -> DataFrame:
    """Without any edge all concepts are one group."""
    return concepts.select("concept").distinct().withColumn("root", F.lit(concepts.agg(F.min("concept")).first()[0]))


def components(concepts: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(concept, root): the smallest concept within reach over overlap edges (a, b)."""
    if edges.isEmpty():
        return _one_group(concepts)
    return reach(concepts.select(F.col("concept").alias("id")), edges, folder).withColumnRenamed("id", "concept")


def extended(labels: DataFrame, concepts: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """``labels`` (concept, root) of ``components`` after more ``concepts`` and overlap ``edges`` (a, b). Only components that an
    edge touches are joined, as one node each; the other labels are read once. A concept that is not known yet begins alone."""
    known = materialize(labels.unionByName(concepts.select("concept").distinct().join(labels, "concept", "left_anti").withColumn("root", F.col("concept"))), folder, "known")
    end = lambda c: known.select(F.col("concept").alias(c), F.col("root").alias(f"root_{c}"))
    links = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b").filter("root_a <> root_b")
    links = materialize(links.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), folder, "links")
    if links.isEmpty():
        return known
    moved = reach(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links, folder).withColumnRenamed("root", "to")
    return known.join(moved, F.col("root") == F.col("id"), "left").select("concept", F.coalesce("to", "root").alias("root"))


def detect(concepts: DataFrame, edges: DataFrame, folder: str, weighted: bool = False, few: int = FEW) -> DataFrame:
    """(concept, root): communities of overlap edges (a, b, weight) by modularity (see ``leiden``), each connected
    and named by its smallest concept; graphs of ``few`` edges are worked on in one task."""
    if edges.isEmpty():
        return _one_group(concepts)
    weight = F.col("weight") if weighted else F.lit(1)
    return leiden(concepts.select(F.col("concept").alias("id")), edges.select("a", "b", weight.alias("w")), folder, few).withColumnRenamed("id", "concept")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the unweighted modularity of a labelling (concept, root)."""
    # merged at every size: labels are small in files, as names repeat, and large in a broadcast, which the driver would collect
    end = lambda x: labels.select(F.col("concept").alias(x), F.col("root").alias(f"r{x}")).hint("merge")
    rows = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    ends = rows.select(F.explode(F.array("ra", "rb")).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("degree"))
    inside = rows.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("ra") == F.col("rb")).alias("inner"))
    squares = ends.agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    return inside.join(squares).select(F.round(F.col("inner") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))


#: Members of a community that are held as one value: a page of its list.
PAGE = 1000


def member_pages(labels: DataFrame, members: DataFrame, folder: str, page: int = PAGE) -> DataFrame:
    """(root, page, place, entity): every community's members once each, by name, in pages. Places are those of a range
    sort less that of the community's first row, so a community of any size spreads over tasks."""
    rows = labels.join(members, "concept").filter("entity is not null").select("root", "entity").distinct()
    rows = materialize(numbered(rows, ["root", "entity"], folder, "listed"), folder, "places")
    first = rows.groupBy("root").agg(F.min("n").alias("first"))
    place = F.col("n") - F.col("first")
    return rows.join(first, "root").select("root", F.floor(place / page).cast("long").alias("page"), place.alias("place"), "entity")


def summarise(labels: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """(root, community, name, n_concepts, n_members, members, summary), numbered by the root's name: places in
    a range sort, so that no task gets all communities. ``members`` is the first of a community's ``pages``."""
    counted = labels.groupBy("root").agg(F.count_distinct("concept").alias("n_concepts"))
    sizes = pages.groupBy("root").agg(F.count(F.lit(1)).alias("n_members"))
    listing = F.transform(F.sort_array(F.collect_list(F.struct("place", "entity"))), lambda x: x.entity)
    head = pages.filter("page = 0").groupBy("root").agg(listing.alias("members"))
    grouped = counted.join(sizes, "root", "left").join(head, "root", "left")
    grouped = grouped.withColumns({"n_members": F.coalesce("n_members", F.lit(0)), "members": F.coalesce("members", F.array().cast("array<string>"))})
    return numbered(grouped, ["root"], folder, "communities").select(
        "root",
        F.concat(F.lit("community_"), F.col("n").cast("string")).alias("community"),
        F.concat(F.lit("Community "), (F.col("n") + 1).cast("string")).alias("name"),
        "n_concepts", "n_members", "members",
        X.fallback_summary(F.lit(""), F.array_join("members", ", ")).alias("summary"),
    )
