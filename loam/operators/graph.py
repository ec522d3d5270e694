"""The layered graph as tables: building, storing, reading, and neighbourhood operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import vector as V
from loam.operators import community, concepts, extract, models, resolve
from loam.operators.adjacency import Adjacent
from loam.sources import sinks
from loam.store import materialize, workspace


@dataclass
class Graph:
    document: DataFrame  # doc_id, source, n_chars
    chunk: DataFrame  # chunk_id, doc_id, idx, text, embedding
    entity: DataFrame  # canon, name, type, description, doc_id, idx, embedding of "name: description"
    has_entity: DataFrame  # chunk_id, entity
    relation: DataFrame  # source, type, target, evidence
    concept_member: DataFrame  # concept, entity
    concept: DataFrame  # concept, description, embedding
    community: DataFrame  # community, name, summary, embedding, n_members, members (the first page of them)
    community_concept: DataFrame  # community, concept
    mention: DataFrame | None = None  # doc_id, idx, pos, name, type, .. as found
    claim: DataFrame | None = None  # doc_id, idx, pos, source, target, type, evidence as found
    flat_entity: DataFrame | None = None  # key, name, type, n_chunks
    community_member: DataFrame | None = None  # community, page, place, entity
    adjacent: Adjacent | None = None  # the edges by node

    @classmethod
    def _tables(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name != "adjacent"]

    def save(self, folder: str) -> None:
        sinks.write_graph({name: getattr(self, name) for name in self._tables() if getattr(self, name) is not None}, folder)
        Adjacent.store(self.relation, f"{folder}/adjacency")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Graph:
        return cls(**sinks.read_graph(spark, folder, cls._tables()), adjacent=Adjacent.load(spark, f"{folder}/adjacency"))

    def edges_of(self, names: DataFrame) -> DataFrame:
        """The columns of ``names`` (name, ..) with each edge (v, source, type, target, evidence) of the node; only
        ``names`` is moved where the edges are laid out by node."""
        if self.adjacent is not None:
            return self.adjacent.of(names)
        rows = self.relation.select("source", "type", "target", "evidence")
        forth = names.join(rows, F.col("name") == F.col("source")).withColumn("v", F.col("target"))
        return forth.unionByName(names.join(rows.filter("source <> target"), F.col("name") == F.col("target")).withColumn("v", F.col("source")))


METHODS = {"components": community.components, "modularity": community.detect}


def build(
    documents: DataFrame, config: Config = DEFAULT, folder: str | None = None, method: str = "modularity",
    names: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[..., DataFrame] = V.embed,
    client: models.Client | None = None, replies: str | None = None, tasks: int = 1, extracted: DataFrame | None = None, chunks: DataFrame | None = None,
) -> Graph:
    """All layers from (doc_id, text, source), each written before the next reads it.

    ``method``: communities by ``modularity`` of concept overlap, or by its connected ``components``.
    ``embed``: the vector model of chunks, entities, concepts and communities, called with a frame,
    its key, a text column and the name of the new column (``vector.model_embed`` makes one of any
    function from texts to a matrix); by default hashed words. Questions need the same one.
    ``names``: a vector model of display names (see ``resolve.merge_similar``); without one, entities
    are merged by canonical key alone.
    ``client``: a model that is asked for entities and relationships, concepts and summaries, by ``tasks`` tasks; what it said is
    kept in the folder ``replies``, and a build that is broken off goes on from there. Without one, the offline stand-ins serve.
    ``extracted``: extractions (doc_id, idx, entities, relationships) made before, in place of asking for them.
    ``chunks``: (chunk_id, doc_id, idx, text) made before, as of files taken as one text (``extract.chunk_joined``); documents then
    have ``n_chars`` in place of ``text``.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    spark = documents.sparkSession
    folder = folder or workspace(spark, "graph")
    keep = lambda df, name: materialize(df, folder, name)
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    chars = (F.length("text") if chunks is None else F.col("n_chars")).cast("long")
    document = keep(documents.select("doc_id", source.alias("source"), chars.alias("n_chars")).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_chars").alias("n_chars")), "document")
    chunk = keep(embed(extract.chunk(documents, config.chunk_size, config.chunk_overlap) if chunks is None else chunks, "chunk_id", "text", "embedding"), "chunk")
    asking = {"client": client, "tasks": tasks, "config": config, "replies": replies or f"{folder}/replies"}
    if extracted is None and client is not None:
        extracted = models.extract_adaptive(chunk, **asking)
    if extracted is not None:
        extracted = keep(extracted.select("doc_id", "idx", "entities", "relationships"), "extraction")
    found = keep(extract.mentions(chunk) if extracted is None else models.named_mentions(extracted), "mention")
    claimed = keep(extract.relationships(found) if extracted is None else models.named_relationships(extracted), "claim")
    resolved = resolve.merge_entities(found)
    if names is not None:
        resolved = resolve.merge_similar(resolved, names, f"{folder}/similar", config.entity_dedup_threshold)
    resolved = keep(resolved, "resolved")
    merged = resolve.upserted(resolved).withColumn("loam_text", F.concat("name", F.lit(": "), F.coalesce("description", F.lit(""))))
    entity = keep(embed(merged, "name", "loam_text", "embedding").drop("loam_text"), "entity")
    cleaned = resolve.clean_relationships(claimed, resolved)
    relation = keep(resolve.ingest_edges(cleaned, entity), "relation")
    has_entity = keep(entity.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")).alias("chunk_id"), F.col("name").alias("entity")), "has_entity")
    drafted = concepts.draft_batches(entity, folder, config.concept_batch) if client is None else models.draft_concepts(entity, **asking)
    members = keep(concepts.resolve_members(drafted, entity), "concept_member")
    described = members.groupBy("concept").agg(F.array_join(F.sort_array(F.collect_set("entity")), " ").alias("description"))
    concept = keep(embed(described, "concept", "description", "embedding"), "concept")
    edges = keep(concepts.overlap(members), "overlap")
    labels = keep(METHODS[method](members.select("concept").distinct(), edges, f"{folder}/{method}"), "labels")
    pages = keep(community.member_pages(labels, members, folder), "member_pages")
    summary = community.summarise(labels, pages, folder)
    if client is not None:
        summary = models.summaries(summary, **asking)
    communities = keep(embed(summary, "community", "summary", "embedding"), "community")
    contains = keep(labels.join(communities.select("root", "community"), "root").select("community", "concept"), "community_concept")
    listed = pages.join(communities.select("root", "community"), "root").select("community", "page", "place", "entity")
    flat_entity = keep(resolve.flat_index(found), "flat_entity")
    return Graph(document, chunk, entity, has_entity, relation, members, concept, communities, contains, found, claimed, flat_entity, keep(listed, "community_member"), Adjacent.store(relation, f"{folder}/adjacency"))


def statistics(graph: Graph, documents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row of counts; model calls: one per extraction batch, concept batch and community."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text") if "text" in documents.columns else "n_chars").alias("characters"))
    for df, name in ((graph.chunk, "chunks"), (graph.entity, "entities"), (graph.relation, "relationships"), (graph.concept, "concepts"), (graph.community, "communities")):
        out = out.join(one(df, name))
    calls = F.ceil(F.col("chunks") / config.extraction_batch) + F.ceil(F.col("entities") / config.concept_batch) + F.col("communities")
    return out.withColumn("llm_calls", calls.cast("long"))


def has_chunk(graph: Graph) -> DataFrame:
    """(doc_id, chunk_id): links of the documents that are there."""
    return graph.chunk.select("doc_id", "chunk_id").join(graph.document.select("doc_id"), "doc_id", "left_semi")


def symmetric(relation: DataFrame) -> DataFrame:
    """(u, v, type): each edge seen from both ends."""
    forth = relation.select(F.col("source").alias("u"), F.col("target").alias("v"), "type")
    return forth.unionByName(relation.select(F.col("target").alias("u"), F.col("source").alias("v"), "type"))


#: Edges that a task follows from a frontier, about.
STEPS = 1 << 19


def _stepped(frontier: DataFrame, both: DataFrame, degree: DataFrame, steps: int) -> tuple[DataFrame, int]:
    """(seed, node): the ends of the edges (u, v) from a frontier (seed, node), and the number of tasks that follow them, about
    ``steps`` each. The seeds that stand at one node are dealt to several tasks where they and its edges multiply to more."""
    many = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("seeds")).join(degree, F.col("node") == F.col("u"))
    many = many.select("u", (F.col("seeds") * F.col("edges")).alias("steps"))
    parts = max(1, -(-(many.agg(F.sum("steps")).first()[0] or 0) // steps))
    shares = many.select("u", F.ceil(F.col("steps") / steps).alias("shares"))
    left = frontier.join(shares, F.col("node") == F.col("u")).select("seed", "u", F.pmod(F.xxhash64("seed"), "shares").alias("share"))
    right = both.join(shares, "u").select("u", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    # dealt so even where one side would fit a broadcast: a task's edges count, not its rows
    met = left.repartition(parts, "u", "share").hint("merge").join(right.repartition(parts, "u", "share"), ["u", "share"])
    return met.select("seed", F.col("v").alias("node")), parts


def neighbourhood(relation: DataFrame, seeds: DataFrame, hops: int = 2, folder: str | None = None, steps: int = STEPS) -> DataFrame:
    """(seed, node, hop): nodes within ``hops`` of each seed, with their smallest distance. Each hop is dealt by the number of
    its edges, so a task follows, and holds, about ``steps`` whatever the size of the graph."""
    folder = folder or workspace(relation.sparkSession, "neighbourhood")
    both = materialize(symmetric(relation).select("u", "v").distinct(), folder, "both")
    degree = materialize(both.groupBy("u").agg(F.count(F.lit(1)).alias("edges")), folder, "degree")
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        reached = materialize(reached, folder, f"hop-{hop - 1}")
        step, parts = _stepped(reached.filter(F.col("hop") == hop - 1).select("seed", "node"), both, degree, steps)
        rows = reached.unionByName(step.withColumn("hop", F.lit(hop))).repartition(parts, "seed", "node")
        reached = rows.groupBy("seed", "node").agg(F.min("hop").alias("hop"))
    return reached


def nodes_where(entity: DataFrame, column: str, values: list[str]) -> DataFrame:
    return entity.filter(F.col(column).isin(values)).select("name")


def ends_where(relation: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Both ends of the edges whose property has one of the values."""
    return relation.filter(F.col(column).isin(values)).select(F.explode(F.array("source", "target")).alias("name")).distinct()


def induced(relation: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among ``names`` (name)."""
    kept = names.select("name").distinct()
    return relation.join(kept.withColumnRenamed("name", "source"), "source", "left_semi").join(kept.withColumnRenamed("name", "target"), "target", "left_semi")
