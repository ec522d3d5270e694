"""Retrieval for a whole table of questions at once: (qid, query, q) with ``q`` the query vector.

Every stage partitions by qid, so one question or a million are one plan. Orders that were left
open are fixed: equal scores go by name or id, discoverers by rank, limits by (source, type,
target). Scores are rounded to six digits before they are compared, so that ties are ties.
"""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as X
from loam.functions import vector as V
from loam.operators.graph import Graph
from loam.operators.similar import nearest
from loam.store import materialize


def asked(questions: DataFrame) -> DataFrame:
    """(qid, q, q_norm): a vector's length is found once a row, not once a pair."""
    return questions.select("qid", "q", V.norm(F.col("q")).alias("q_norm"))


def embedded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "embedding", V.norm(F.col("embedding")).alias("embedding_norm"))


def scored(pairs: DataFrame, out: str = "similarity") -> DataFrame:
    """``pairs`` of ``asked`` and ``embedded`` rows with their cosine."""
    return pairs.withColumn(out, V.rounded(V.unrolled_dot("q", "embedding") / (F.col("q_norm") * F.col("embedding_norm") + V.EPSILON), 6))


def ranked(rows: DataFrame, score: str, tie: str, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), F.asc(tie))))


def best(rows: DataFrame, score: str, tie: str, k: int, least: float | None = None) -> DataFrame:
    """The k best rows of each question; below ``least`` only the very best stands in."""
    out = ranked(rows, score, tie).filter(F.col("rank") <= k)
    return out if least is None else out.filter((F.col(score) >= least) | (F.col("rank") == 1))


def top_chunks(questions: DataFrame, chunk: DataFrame, k: int = DEFAULT.top_k_chunks) -> DataFrame:
    """Vector-only retrieval: (qid, chunk_id, similarity, rank). Questions are the stated set that
    is held against all chunks; every task keeps k rows a question."""
    return best(nearest(chunk, questions, "chunk_id", k), "similarity", "chunk_id", k).select("qid", "chunk_id", "similarity", "rank")


def match_communities(questions: DataFrame, graph: Graph, config: Config = DEFAULT) -> DataFrame:
    """(qid, community, similarity, rank)."""
    rows = nearest(graph.community, questions, "community", config.top_k_communities)
    found = best(rows, "similarity", "community", config.top_k_communities, config.min_community_similarity)
    return found.select("qid", "community", "similarity", "rank")


def drill(questions: DataFrame, matched: DataFrame, graph: Graph, config: Config = DEFAULT) -> DataFrame:
    """(qid, concept, community, relevance, rank): concepts under the matched communities."""
    rows = matched.join(graph.community_concept, "community").groupBy("qid", "concept").agg(F.min_by("community", "rank").alias("community"))
    rows = rows.join(embedded(graph.concept, "concept"), "concept").join(asked(questions), "qid")
    found = best(scored(rows, out="relevance"), "relevance", "concept", config.top_k_concepts, config.min_concept_relevance)
    return found.select("qid", "concept", "community", "relevance", "rank")


def seeds(drilled: DataFrame, graph: Graph) -> DataFrame:
    """(qid, name, from_concept, hop 0): each member under its best concept."""
    rows = drilled.select("qid", "concept", "rank").join(graph.concept_member, "concept")
    first = rows.groupBy("qid", "entity").agg(F.min_by("concept", "rank").alias("from_concept"))
    return first.select("qid", F.col("entity").alias("name"), "from_concept", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("reached_via"))


def expand(start: DataFrame, graph: Graph, hops: int = DEFAULT.max_hops) -> DataFrame:
    """Breadth-first over discourse edges in both directions; a node is found once, by the
    smallest (source, type) of the hop that reaches it first."""
    reached, frontier = start, start
    for hop in range(1, hops + 1):
        step = graph.edges_of(frontier.select("qid", "name")).select("qid", F.col("name").alias("src"), "type", F.col("v").alias("name"))
        step = step.join(reached.select("qid", "name"), ["qid", "name"], "left_anti")
        via = F.min(F.struct("src", "type")).alias("via")
        frontier = step.groupBy("qid", "name").agg(via).select(
            "qid", "name", F.lit(None).cast("string").alias("from_concept"), F.lit(hop).alias("hop"), X.path_step(F.col("via.src"), F.col("via.type"), F.col("name")).alias("reached_via")
        )
        reached = reached.unionByName(frontier)
    return reached


def collect(questions: DataFrame, reached: DataFrame, graph: Graph, config: Config = DEFAULT) -> DataFrame:
    """(qid, name, type, description, from_concept, hop, reached_via, relevance, rank): at most
    ``max_entities`` a question, by likeness of "name: description", whose vector is stored."""
    rows = reached.join(embedded(graph.entity, "name", "type", "description"), "name").join(asked(questions), "qid")
    found = best(scored(rows, out="relevance"), "relevance", "name", config.max_entities)
    return found.select("qid", "name", "type", "description", "from_concept", "hop", "reached_via", "relevance", "rank")


def _marked(names: DataFrame, graph: Graph) -> DataFrame:
    """Edges that touch a question's names: (qid, source, type, target, evidence, inner)."""
    seen = graph.edges_of(names.select("qid", "name").distinct())
    # an edge found from both ends is inside, and one of a node to itself
    inner = (F.count(F.lit(1)) > 1) | (F.col("source") == F.col("target"))
    return seen.groupBy("qid", "source", "type", "target").agg(F.first("evidence").alias("evidence"), inner.alias("inner"))


def inner_edges(names: DataFrame, graph: Graph) -> DataFrame:
    return _marked(names, graph).filter("inner").drop("inner")


def boundary_edges(names: DataFrame, graph: Graph, limit: int = DEFAULT.max_boundary_edges) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("source", "type", "target")
    return _marked(names, graph).filter("not inner").drop("inner").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def relationships(names: DataFrame, graph: Graph, config: Config = DEFAULT) -> DataFrame:
    """Inner edges first, then the boundary ones: (qid, place, source, type, target, evidence)."""
    rows = inner_edges(names, graph).withColumn("phase", F.lit(0)).unionByName(boundary_edges(names, graph, config.max_boundary_edges).withColumn("phase", F.lit(1)))
    order = Window.partitionBy("qid").orderBy("phase", "source", "type", "target")
    return rows.withColumn("place", F.row_number().over(order) - 1).select("qid", "place", "source", "type", "target", "evidence")


def chain_order(edges: list[tuple[str, str]]) -> list[int]:
    """Places of the edges so that one's target is the next one's source where that can be.

    Starts are sources that nothing points to, else all sources, in order of appearance.
    """
    if len(edges) <= 1:
        return list(range(len(edges)))
    waiting: dict[str, list[int]] = {}
    for place in reversed(range(len(edges))):
        waiting.setdefault(edges[place][0], []).append(place)
    targets = {target for _, target in edges}
    appear = list(dict.fromkeys(source for source, _ in edges))
    out: list[int] = []
    for node in [s for s in appear if s not in targets] or appear:
        while waiting.get(node):
            out.append(waiting[node].pop())
            node = edges[out[-1]][1]
    done = set(out)
    return out + [place for place in range(len(edges)) if place not in done]


def chained(rows: DataFrame) -> DataFrame:
    """``relationships`` with ``step``: a question's edges in chain order (a few hundred at most)."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", ignore_index=True)
        order = chain_order(list(zip(part.source, part.target, strict=True)))
        out = part.iloc[order].reset_index(drop=True)
        out["step"] = range(len(out))
        return out[["qid", "step", "source", "type", "target", "evidence"]]

    return rows.groupBy("qid").applyInPandas(work, "qid long, step long, source string, type string, target string, evidence string")


def bridging(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name): ends of a question's edges that were not retrieved."""
    ends = edges.select("qid", F.explode(F.array("source", "target")).alias("name")).distinct()
    return ends.join(names.select("qid", "name"), ["qid", "name"], "left_anti")


def context(questions: DataFrame, names: DataFrame, graph: Graph, config: Config = DEFAULT) -> DataFrame:
    """(qid, chunk_id, doc_id, idx, similarity, source, selected) of the names' chunks.

    More than ``graph_top_k_chunks`` candidates: the two best of each detected source come first,
    sources in the order of their best chunk, then the rest by similarity; cut at k.
    """
    k = config.graph_top_k_chunks
    found = names.select("qid", "name").distinct().join(graph.has_entity, F.col("name") == F.col("entity")).select("qid", "chunk_id").distinct()
    rows = found.join(embedded(graph.chunk, "chunk_id", "doc_id", "idx", "text"), "chunk_id").join(asked(questions), "qid")
    rows = scored(rows).select("qid", "chunk_id", "doc_id", "idx", "similarity", X.detected_source(F.col("text")).alias("source"))
    by_rank = Window.partitionBy("qid").orderBy(F.desc("similarity"), "chunk_id")
    rows = rows.withColumns({"rank": F.row_number().over(by_rank), "candidates": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    group = Window.partitionBy("qid", "source")
    rows = rows.withColumns({"lead": F.min("rank").over(group), "nth": F.row_number().over(group.orderBy("rank"))})
    early = (F.col("nth") <= 2) & (F.col("candidates") > k)
    keys = F.when(early, F.struct(F.lit(0).alias("phase"), F.col("lead").alias("x"), F.col("nth").alias("y"))).otherwise(F.struct(F.lit(1).alias("phase"), F.col("rank").alias("x"), F.lit(0).alias("y")))
    rows = rows.withColumn("choice", F.row_number().over(Window.partitionBy("qid").orderBy(keys)))
    return rows.select("qid", "chunk_id", "doc_id", "idx", "similarity", "source", "choice").filter(F.col("choice") <= k)


def in_reading_order(chosen: DataFrame, graph: Graph) -> DataFrame:
    """(qid, chunks): each question's chunk texts by (doc_id, idx)."""
    rows = chosen.join(graph.chunk.select("chunk_id", "text"), "chunk_id")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "idx", "text"))), lambda x: x.text)
    return rows.groupBy("qid").agg(texts.alias("chunks"))


def by_rank(found: DataFrame, graph: Graph) -> DataFrame:
    """(qid, chunks): the texts of vector retrieval, best first."""
    rows = found.join(graph.chunk.select("chunk_id", "text"), "chunk_id")
    return rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("chunks"))


class Retrieval:
    """The stages' tables for a table of questions, each made when first asked for.

    With a ``folder`` every stage is written there and read again, so later stages start from
    small tables and a lost executor costs one stage; without one the whole is a single lazy plan.
    """

    def __init__(self, questions: DataFrame, graph: Graph, config: Config = DEFAULT, folder: str | None = None):
        self.questions, self.graph, self.config, self.folder = questions, graph, config, folder

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, self.folder, name) if self.folder else df

    @cached_property
    def communities(self) -> DataFrame:
        return self._keep(match_communities(self.questions, self.graph, self.config), "communities")

    @cached_property
    def concepts(self) -> DataFrame:
        return self._keep(drill(self.questions, self.communities, self.graph, self.config), "concepts")

    @cached_property
    def reached(self) -> DataFrame:
        return self._keep(expand(seeds(self.concepts, self.graph), self.graph, self.config.max_hops), "reached")

    @cached_property
    def entities(self) -> DataFrame:
        return self._keep(collect(self.questions, self.reached, self.graph, self.config), "entities")

    @cached_property
    def relationships(self) -> DataFrame:
        return self._keep(relationships(self.entities, self.graph, self.config), "relationships")

    @cached_property
    def bridging(self) -> DataFrame:
        return self._keep(bridging(self.relationships, self.entities), "bridging")

    @cached_property
    def context(self) -> DataFrame:
        names = self.entities.select("qid", "name").unionByName(self.bridging)
        return self._keep(context(self.questions, names, self.graph, self.config), "context")

    @property
    def path(self) -> DataFrame:
        """One row a question: how many of each kind were found."""
        stages = {"n_communities": self.communities, "n_concepts": self.concepts, "n_entities": self.entities, "n_relationships": self.relationships, "n_bridging": self.bridging, "n_chunks": self.context}
        counted = self.questions.select("qid", F.lit(None).cast("string").alias("stage"))
        for name, df in stages.items():
            counted = counted.unionByName(df.select("qid", F.lit(name).alias("stage")))
        return counted.groupBy("qid").agg(*[F.count_if(F.col("stage") == name).alias(name) for name in stages])


def relationship_lines(rows: DataFrame, limit: int = DEFAULT.max_relationships_for_llm, evidence: int | None = 300, order: str = "step") -> DataFrame:
    """(qid, listing): numbered relationship lines for a prompt."""
    said = X.strip(F.coalesce("evidence", F.lit(""))) if "evidence" in rows.columns else F.lit("")
    said = F.substring(said, 1, evidence) if evidence else said
    line = F.concat((F.col(order) + 1).cast("string"), F.lit(". "), F.col("source"), F.lit(" --["), F.col("type"), F.lit("]--> "), F.col("target"), F.when(said != "", F.concat(F.lit(" | "), said)).otherwise(""))
    kept = rows.filter(F.col(order) < limit).withColumn("line", line)
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x.line), "\n").alias("listing"))


#: Forms of the answer prompt: relationship lines, evidence characters, chunks and characters a
#: chunk that each shows (None: all), and what it asks for.
FORMS = {
    "graph": (DEFAULT.max_relationships_for_llm, 300, None, DEFAULT.max_chunk_chars, "Relationships:\n"),
    "flat": (DEFAULT.flat_relationships, 200, None, DEFAULT.max_chunk_chars, "Entity relationships:\n"),
    "baseline": (0, 0, None, None, ""),
    "short": (10, None, 5, None, "In three to five sentences.\n\nRelationships:\n"),
}


def prompts(questions: DataFrame, lines: DataFrame | None, chunks: DataFrame, limit: int | None = DEFAULT.max_chunk_chars, form: str = "graph") -> DataFrame:
    """(qid, prompt) from (qid, listing) and (qid, chunks), without relationships where ``lines`` is None."""
    _, _, most, _, head = FORMS[form]
    rows = questions.select("qid", "query").join(chunks, "qid", "left")
    texts = F.coalesce("chunks", F.array().cast("array<string>"))
    shown = X.joined_chunks(F.slice(texts, 1, most) if most else texts, limit)
    parts = [F.lit("Context:\n"), shown, F.lit("\n\nQuestion: "), F.col("query")]
    if lines is not None:
        rows = rows.join(lines, "qid", "left")
        parts = [F.lit(head), F.coalesce("listing", F.lit("(none)")), F.lit("\n\n"), *parts]
    return rows.select("qid", F.concat(*parts).alias("prompt"))


def formed(form: str, questions: DataFrame, edges: DataFrame | None, chunks: DataFrame, order: str = "step") -> DataFrame:
    """(qid, prompt) in one of the ``FORMS`` from a question's edges (qid, ``order``, ..) and chunks."""
    n, evidence, _, limit, _ = FORMS[form]
    lines = relationship_lines(edges, n, evidence, order) if n and edges is not None else None
    return prompts(questions, lines, chunks, limit, form)


def path_lines(found: Retrieval, samples: int = 4) -> DataFrame:
    """(qid, section, place, line): what a question's retrieval went through, to be printed:
    communities with bars, concepts, counts, and the first discourse paths."""
    named = found.communities.join(found.graph.community.select("community", "name"), "community")
    bar = X.bar(F.greatest("similarity", F.lit(0.0)), 20)
    first = named.select("qid", F.lit(1).alias("section"), F.col("rank").alias("place"), F.concat(F.lit("["), bar, F.lit("] "), F.format_number("similarity", 3), F.lit("  "), F.col("name")).alias("line"))
    second = found.concepts.select("qid", F.lit(2).alias("section"), F.col("rank").alias("place"), F.concat(F.lit("* "), F.col("concept"), F.lit(" (relevance="), F.format_number("relevance", 3), F.lit(")")).alias("line"))
    counts = found.path.select("qid", F.lit(3).alias("section"), F.lit(1).alias("place"), F.format_string("%d entities, %d chunks, %d relationships", "n_entities", "n_chunks", "n_relationships").alias("line"))
    ways = found.entities.filter("reached_via is not null").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    last = ways.filter(F.col("place") <= samples).select("qid", F.lit(4).alias("section"), "place", F.concat(F.lit("> "), F.col("reached_via")).alias("line"))
    return first.unionByName(second).unionByName(counts).unionByName(last)
