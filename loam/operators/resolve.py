"""Entity resolution: merging by canonical key, similarity merging, relationship cleaning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam import store
from loam.config import DEFAULT
from loam.functions import text as X
from loam.operators import similar
from loam.operators.extract import ORDER
from loam.operators.similar import similar_pairs
from loam.store import materialize


def _place() -> Column:
    return F.struct(*ORDER)


def _earliest_longest(value: str) -> Column:
    """The longest value, the earliest of equally long ones."""
    return F.max_by(value, F.struct(F.length(value), *[-F.col(c) for c in ORDER]))


def merge_entities(found: DataFrame) -> DataFrame:
    """One row a canonical key: first type and chunk, longest name and description.

    Partial aggregation keeps one row a key and task before the shuffle, so frequent names
    don't skew it.
    """
    rows = found.withColumn("canon", X.canonical_key(F.col("name"))).filter("canon <> ''")
    return rows.groupBy("canon").agg(
        _earliest_longest("name").alias("name"),
        F.min_by("type", _place()).alias("type"),
        _earliest_longest("description").alias("description"),
        F.min_by("doc_id", _place()).alias("doc_id"),
        F.min_by("idx", _place()).alias("idx"),
        F.min(_place()).alias("first_place"),
        F.count(F.lit(1)).alias("n_mentions"),
    )


def entity_shares(found: DataFrame) -> DataFrame:
    """What a part of the mentions knows of each canonical key, with the places that decide between parts; see ``merged_shares``."""
    later = [-F.col(c) for c in ORDER]
    longest = lambda c: F.max(F.struct(F.length(c).alias("n"), *[x.alias(f"p{k}") for k, x in enumerate(later)], F.col(c).alias("value")))
    rows = found.withColumn("canon", X.canonical_key(F.col("name"))).filter("canon <> ''")
    return rows.groupBy("canon").agg(longest("name").alias("name"), longest("description").alias("description"), F.min(F.struct(*ORDER, "type")).alias("first"), F.count(F.lit(1)).alias("n_mentions"))


def merged_shares(shares: DataFrame) -> DataFrame:
    """The rows of ``merge_entities`` from the shares of any parts of the mentions, whatever their order: least and largest of
    the same structs."""
    rows = shares.groupBy("canon").agg(F.max("name").alias("name"), F.max("description").alias("description"), F.min("first").alias("first"), F.sum("n_mentions").alias("n_mentions"))
    place = F.struct(*[F.col(f"first.{c}").alias(c) for c in ORDER])
    return rows.select("canon", F.col("name.value").alias("name"), F.col("first.type").alias("type"), F.col("description.value").alias("description"), "first.doc_id", "first.idx", place.alias("first_place"), "n_mentions")


def first_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each pair of endpoints, as keyed and as titled, and kind: ``clean_relationships`` makes the same of these
    as of all, with whatever names entities get later, as what it compares is the same within each."""
    # sorted by plain strings, which is cheaper than by structs
    keyed = claims.withColumns({"s_key": X.canonical_key(F.col("source")), "s_title": X.entity_name(F.col("source")), "t_key": X.canonical_key(F.col("target")), "t_title": X.entity_name(F.col("target")), "kind": F.lower(F.coalesce("type", F.lit("")))})
    first = F.min_by(F.struct("source", "target", "type", "evidence", *ORDER), _place()).alias("r")
    return keyed.groupBy("s_key", "t_key", "kind", "s_title", "t_title").agg(first).select("r.*")


def numbered(entities: DataFrame, folder: str) -> DataFrame:
    """``entities`` with their number ``n`` from 0 in entity order (the first mention's place)."""
    return store.numbered(entities, ["first_place", "canon"], folder)


def flat_index(found: DataFrame) -> DataFrame:
    """(key, name, type, n_chunks): entities by lower-case name, as first written."""
    rows = found.filter("name <> ''").withColumn("key", F.lower("name"))
    return rows.groupBy("key").agg(F.min_by("name", _place()).alias("name"), F.min_by("type", _place()).alias("type"), F.count(F.lit(1)).alias("n_chunks"))


def flat_postings(found: DataFrame) -> DataFrame:
    """(key, doc_id, idx): every chunk that mentions an entity, a row a mention: a common name's
    chunks are never one value."""
    return found.filter("name <> ''").select(F.lower("name").alias("key"), "doc_id", "idx")


def upserted(entities: DataFrame) -> DataFrame:
    """Entity nodes by name: where several keys have one display name, the last one written stands."""
    kept = [c for c in entities.columns if c != "name"]
    last = F.max_by(F.struct(*kept), F.struct("first_place", "canon")).alias("node")
    return entities.groupBy("name").agg(last).select("name", "node.*").select(*entities.columns)


#: Undecided ids that a task may finish by itself, with as many pairs.
FEW = 50_000


def _scanned(open_: DataFrame) -> DataFrame:
    """(id, leader) of what is still open, by one scan in id order, in one task."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        leader: dict[int, int] = {}
        for hi, lo, known in zip(part.hi, part.lo, part.known, strict=True):
            if lo >= 0:
                below.setdefault(int(hi), []).append(int(lo))
                if known >= 0:
                    leader[int(lo)] = int(known)
            else:
                below.setdefault(int(hi), [])
        for id_ in sorted(below):
            leads = [lo for lo in below[id_] if leader[lo] == lo]
            leader[id_] = min(leads, default=id_)
        return pd.DataFrame({"id": sorted(below), "leader": [leader[i] for i in sorted(below)]}, dtype="int64")

    return open_.groupBy(F.lit("all")).applyInPandas(work, "id long, leader long")


def leaders(pairs: DataFrame, ids: DataFrame, folder: str, few: int = FEW) -> DataFrame:
    """(id, leader): greedy merging in id order. An id that no smaller leader is similar to leads;
    any other follows its smallest similar leader. Not transitive.

    The sequential scan equals the lexicographically first maximal independent set, found in
    rounds: an undecided id leads once every smaller neighbour follows someone, and follows
    once a smaller neighbour leads. Each round is a join, cut off by a written table. What is open goes down
    fast unless ids form long chains; as soon as it is ``few`` ids and pairs, a task scans it.
    """
    down = pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    down = materialize(down, folder, "down")
    state = materialize(ids.select("id", F.lit(None).cast("long").alias("leader")), folder, "round-0")
    k = 0
    while True:
        k += 1
        lower = state.select(F.col("id").alias("lo"), F.col("leader").alias("lo_leader"))
        seen = down.join(lower, "lo").groupBy("hi").agg(
            F.min(F.when(F.col("lo_leader") == F.col("lo"), F.col("lo"))).alias("leads"), F.max(F.col("lo_leader").isNull()).alias("open")
        )
        joined = state.join(seen, state.id == seen.hi, "left")
        # an undecided smaller neighbour might still lead, and be smaller than the leader at hand
        open_below = F.coalesce("open", F.lit(False))
        after = F.when(F.col("leader").isNotNull(), F.col("leader")).when(~open_below & F.col("leads").isNotNull(), F.col("leads")).when(~open_below, F.col("id"))
        state = materialize(joined.select("id", after.alias("leader")), folder, f"round-{k}")
        open_ = state.filter("leader is null").select(F.col("id").alias("hi"))
        if open_.isEmpty():
            return state
        known = state.select(F.col("id").alias("lo"), F.coalesce("leader", F.lit(-1)).alias("known"))
        left = open_.join(down, "hi", "left").join(known, "lo", "left").select("hi", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("known", F.lit(-1)).alias("known"))
        if left.limit(few + 1).count() <= few:
            last = materialize(_scanned(left), folder, "scanned").withColumnRenamed("leader", "found")
            return state.join(last, "id", "left").select("id", F.coalesce("leader", "found").alias("leader"))


def led(rows: DataFrame, key: str, vector: str, threshold: float, folder: str) -> DataFrame:
    """(id, leader): greedy merging in id order by the cosine of vectors; rows without a sound vector lead none but themselves.
    Where an id has several rows, whichever are so similar count, which takes all pairs."""
    ids = rows.select(F.col(key).cast("long").alias("id"))
    known = materialize(ids.filter("id is not null").groupBy("id").count(), folder, "ids")
    if not known.filter("count > 1").isEmpty():
        return leaders(similar_pairs(rows, key, vector, threshold), ids.distinct(), folder)
    found = materialize(similar.leaders(rows, key, vector, threshold, folder), folder, "found")
    # many ids are few bytes in files
    return ids.distinct().join(found.hint("merge"), "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def merge_similar(entities: DataFrame, embed: Callable[[DataFrame], DataFrame], folder: str, threshold: float = DEFAULT.entity_dedup_threshold) -> DataFrame:
    """``entities`` (of ``merge_entities``) after the second phase: in entity order, each absorbs the
    later ones whose display name is at least so similar and that none absorbed before.

    ``embed`` adds ``name_vector`` to a frame with ``name``. An absorbed entity leaves its
    description, mentions and longer name; its key goes, so edges that name it fall away at ingest. Entities with
    one vector have the same partners, so the first of them decides for all: only it is compared.
    """
    rows = materialize(embed(numbered(entities, folder)), folder, "named")
    alike = materialize(rows.groupBy("name_vector").agg(F.min("n").alias("first")), folder, "alike")
    pairs = materialize(similar_pairs(alike, "first", "name_vector", threshold), folder, "pairs")
    led = leaders(pairs.select("a", "b"), alike.select(F.col("first").alias("id")), f"{folder}/leaders")
    # no vector, no partner
    # merged at every size: vectors of many zeros are small in files and large in a broadcast, which the driver would collect
    whole = rows.select("n", "name_vector").join(alike.hint("merge"), "name_vector").join(led.hint("merge"), F.col("first") == F.col("id")).select("n", "leader")
    whole = whole.join(rows.filter("name_vector is null or size(name_vector) = 0").select("n"), "n", "left_anti")
    described = rows.join(whole, "n", "left").withColumn("leader", F.coalesce("leader", "n")).withColumn("said", F.coalesce("description", F.lit("")))
    merged = described.groupBy("leader").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("n"))).alias("name"),
        *[F.min_by(c, "n").alias(c) for c in ("canon", "type", "doc_id", "idx", "first_place")],
        F.sum("n_mentions").alias("n_mentions"),
    )
    # the longest description, the first of equally long ones, in the last way of writing it
    forms = described.groupBy("leader", F.length("said").alias("long"), F.lower("said").alias("lower")).agg(F.min("n").alias("first"), F.max_by("said", "n").alias("said"))
    best = forms.groupBy("leader").agg(F.max_by("said", F.struct("long", -F.col("first"))).alias("description"))
    return merged.join(best, "leader").select(*entities.columns)


def resolve(names: Column, canon_known: Column) -> Column:
    """The display name of an endpoint: that of its key, else its own title."""
    return F.coalesce(canon_known, X.entity_name(names))


def clean_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints as display names, no self-loops, the first of each (source, type, target) key."""
    # the key of a display name is made once an entity, not once a claim
    names = entities.select("canon", F.col("name").alias("display"), X.canonical_key(F.col("name")).alias("named"))
    rows = relationships.withColumns({"s_key": X.canonical_key(F.col("source")), "t_key": X.canonical_key(F.col("target"))})
    rows = rows.join(names.select(F.col("canon").alias("s_key"), F.col("display").alias("s_name"), F.col("named").alias("s_named")), "s_key", "left")
    rows = rows.join(names.select(F.col("canon").alias("t_key"), F.col("display").alias("t_name"), F.col("named").alias("t_named")), "t_key", "left")
    keyed = lambda end, known: F.coalesce(known, X.canonical_key(X.entity_name(F.col(end))))
    rows = rows.withColumns({
        "source": resolve(F.col("source"), F.col("s_name")), "target": resolve(F.col("target"), F.col("t_name")), "kind": F.lower(F.coalesce("type", F.lit(""))),
        "source_key": keyed("source", "s_named"), "target_key": keyed("target", "t_named"),
    })
    rows = rows.filter("source <> '' and target <> '' and source <> target")
    first = F.min_by(F.struct("source", "target", "type", "evidence", *ORDER), _place()).alias("r")
    return rows.groupBy("source_key", "kind", "target_key").agg(first).select("source_key", "kind", "target_key", "r.*")


def ingest_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Stored edges (source, type, target, evidence): both ends exist, the last evidence wins."""
    nodes = entities.select("name")
    rows = relationships.withColumn("type", X.relation_type(F.col("type")))
    rows = rows.join(nodes.withColumnRenamed("name", "source"), "source", "left_semi").join(nodes.withColumnRenamed("name", "target"), "target", "left_semi")
    return rows.groupBy("source", "type", "target").agg(F.max_by("evidence", _place()).alias("evidence"))
