"""The engine's operators as queries over the driver's tables, each with its SQL.

The graph is stored once per input folder (the build), and retrieval queries read the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT
from loam.functions import text as X
from loam.functions import vector as V
from loam.operators import client, community, concepts, evaluate, explain, extract, flat, graph, index, leiden, resolve, retrieve, similar
from loam.plans.oracle import SOURCE, canon, cosine, strip
from loam.plans.oracle import sql as chain
from loam.store import materialize, workspace
from loam.streaming import ingest

_STORES: dict[tuple, graph.Graph] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(spark: SparkSession, path: str) -> tuple:
    """When the files under a path were last written, and how long they are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((str(f.getPath()), f.getModificationTime(), f.getLen()) for f in system.listStatus(at)))


def stored(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The graph of a folder's documents, built when first asked for, and again when they change."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _STORES:
        _STORES[key] = graph.build(_table(spark, sf_dir, "documents"))
    return _STORES[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return V.embed(rows, "qid", "query", "q")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, plain: bool = False):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle if plain else chain(oracle)
        return f

    return register


# ---- text ----


@query("chunk_text", "select chunk_id, doc_id, idx::bigint as idx, md5(text) as text_md5, length(text)::bigint as n_chars from chunk")
def _(spark, d):
    return extract.chunk(_table(spark, d, "documents")).select("chunk_id", "doc_id", "idx", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("chunk_stats", "select doc_id, count(*)::bigint as n_chunks, sum(length(text))::bigint as chars, max(length(text))::bigint as longest from chunk0 group by doc_id")
def _(spark, d):
    rows = extract.chunk(_table(spark, d, "documents"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


# all documents of a source as one text
@query("chunk_joined", f"""select source || '_chunk_' || idx as chunk_id, source, idx::bigint as idx, md5(text) as text_md5, length(text)::bigint as n_chars from (
    select source, row_number() over (partition by source order by p) - 1 as idx, txt as text from (
      select source, p, {strip("substr(text, p + 1, 1500)")} as txt from (select source, string_agg(coalesce(text, ''), chr(10) || chr(10) order by doc_id) as text from documents where source is not null group by source),
        unnest(range(0, length(text), 1350)) as u(p)) where txt <> '')""", plain=True)
def _(spark, d):
    rows = extract.chunk_joined(_table(spark, d, "documents"), "source", "doc_id", workspace(spark, "joined"))
    return rows.select("chunk_id", F.col("doc_id").alias("source"), "idx", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(
    "title_case",
    f"""select doc_id, array_to_string(list_transform(regexp_extract_all({strip("text")}, '\\p{{L}}+|\\P{{L}}+'),
    lambda r: case when r[1] = 'ß' then 'Ss' else upper(r[1]) end || lower(substr(r, 2))), '') as title from documents""",
)
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.entity_name(F.col("text")).alias("title"))


_NAMES = "select doc_id, case doc_id % 4 when 0 then ' The ' || text || ' (UN)  x' when 1 then 'A The ' || text when 2 then 'An ' || text else text end as name from documents"


@query("canonical_key", f"select doc_id, {canon('name')} as canon from ({_NAMES})")
def _(spark, d):
    # whole texts in four forms: an article, two, one, and an abbreviation in parentheses
    k, text = F.col("doc_id") % 4, F.col("text")
    name = F.when(k == 0, F.concat(F.lit(" The "), text, F.lit(" (UN)  x"))).when(k == 1, F.concat(F.lit("A The "), text)).when(k == 2, F.concat(F.lit("An "), text)).otherwise(text)
    return _table(spark, d, "documents").select("doc_id", X.canonical_key(name).alias("canon"))


@query("make_id", "select doc_id, substr(md5(text), 1, 12) as id, 'extraction_' || substr(md5(source), 1, 10) || '.json' as cache from documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.short_id(F.col("text")).alias("id"), X.cache_key(F.col("source")).alias("cache"))


@query(
    "rel_type_sanitize",
    "select event_id, coalesce(nullif(regexp_replace(upper(event_type || ' to-' || user_id), '[^A-Z0-9_]', '_', 'g'), ''), 'RELATED_TO') as type, lower(replace(regexp_replace(upper(event_type || ' to-' || user_id), '[^A-Z0-9_]', '_', 'g'), '_', ' ')) as shown from events",
)
def _(spark, d):
    kind = X.relation_type(F.concat("event_type", F.lit(" to-"), F.col("user_id").cast("string")))
    return _table(spark, d, "events").select("event_id", kind.alias("type"), X.shown_relation(kind).alias("shown"))


@query("strip_think", f"select conv_id, turn, md5({strip('text')}) as answer_md5 from conversations")
def _(spark, d):
    reply = F.concat(F.lit("<think>first\n"), F.upper("role"), F.lit("</think>\n "), F.col("text"), F.lit(" <think>x</think>"))
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.strip_think(reply)).alias("answer_md5"))


@query("json_parse", "select event_id, case event_id % 5 when 4 then null else (props->>'$.k')::bigint end as k from events")
def _(spark, d):
    k, props = F.col("event_id") % 5, F.col("props")
    reply = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nDone [1].")))
        .when(k == 1, props)
        .when(k == 2, F.concat(F.lit("The answer is "), props, F.lit(" as asked")))
        .when(k == 3, F.concat(F.lit("```\n"), props, F.lit("```")))
        .otherwise(F.concat(F.lit("broken {"), props))
    )
    return _table(spark, d, "events").select("event_id", F.get_json_object(X.reply_json(reply), "$.k").cast("long").alias("k"))


@query("detect_source", "select chunk_id, " + SOURCE.format(t="text") + " as source from chunk")
def _(spark, d):
    return extract.chunk(_table(spark, d, "documents")).select("chunk_id", X.detected_source(F.col("text")).alias("source"))


@query("score_format", "select event_id, greatest(0.0, least(1.0, value / 100))::double as clamped, repeat('#', floor(greatest(0.0, least(1.0, value / 100)) * 30)::int) || repeat('.', 30 - floor(greatest(0.0, least(1.0, value / 100)) * 30)::int) as bar from events")
def _(spark, d):
    score = X.clamp((F.col("value") / 100).cast("string"))
    return _table(spark, d, "events").select("event_id", score.alias("clamped"), X.bar(score).alias("bar"))


@query(
    "context_render",
    "select doc_id, md5(string_agg(case when length(text) > 1200 then substr(text, 1, 1200) || '...' else text end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by idx)) as context_md5 from chunk0 group by doc_id",
)
def _(spark, d):
    rows = extract.chunk(_table(spark, d, "documents")).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x.text).alias("chunks"))
    return rows.select("doc_id", F.md5(X.joined_chunks(F.col("chunks"))).alias("context_md5"))


# ---- extraction and merging ----


@query("extraction_batches", "select doc_id, (idx // 3)::bigint as batch, count(*)::bigint as n_segments, md5(string_agg('=== Segment ' || (idx % 3 + 1) || ' ===' || chr(10) || text, chr(10) || chr(10) order by idx)) as segments_md5 from chunk0 group by doc_id, idx // 3")
def _(spark, d):
    rows = extract.batches(extract.chunk(_table(spark, d, "documents")))
    return rows.select("doc_id", F.col("batch").cast("long").alias("batch"), "n_segments", F.md5("segments").alias("segments_md5"))


@query("mentions", "select doc_id, idx::bigint as idx, pos::bigint as pos, name, type, description from mention")
def _(spark, d):
    return extract.mentions(extract.chunk(_table(spark, d, "documents")))


@query("entity_merge", "select canon, name, type, description, doc_id, idx::bigint as idx, n_mentions::bigint as n_mentions from entity")
def _(spark, d):
    return resolve.merge_entities(extract.mentions(extract.chunk(_table(spark, d, "documents")))).drop("first_place")


@query("rel_dedup", "select source_key, kind, target_key, source, target, type, evidence, doc_id, idx::bigint as idx, pos::bigint as pos from clean_relation")
def _(spark, d):
    found = extract.mentions(extract.chunk(_table(spark, d, "documents")))
    return resolve.clean_relationships(extract.relationships(found), resolve.merge_entities(found))


# A vector model that SQL can repeat: how often each letter stands at an odd and at an even place.
_LETTERS = "list_transform(range(52), lambda k: length(list_filter(range(1, length(name) + 1), lambda i: ascii(lower(name[i])) = 97 + k // 2 and i % 2 = k % 2))::double)"


def _letters(rows: DataFrame) -> DataFrame:
    each = F.split(F.lower("name"), "")
    even, odd = F.transform(each, lambda c, i: F.when((i + 1) % 2 == 0, c).otherwise("")), F.transform(each, lambda c, i: F.when((i + 1) % 2 == 1, c).otherwise(""))
    count = lambda k: F.size(F.filter("loam_even" if k % 2 == 0 else "loam_odd", lambda c: c == chr(97 + k // 2))).cast("double")
    return rows.withColumns({"loam_even": even, "loam_odd": odd}).withColumn("name_vector", F.array(*[count(k) for k in range(52)])).drop("loam_even", "loam_odd")


# the scan over all names in entity order, step by step; equal vectors have equal partners, so it goes over the first of each
@query("entity_resolved", f"""select * from (with recursive vectors as (select *, {_LETTERS} as v from numbered), firsts as (select v, min(n) as first, sqrt(list_dot_product(v, v)) as l from vectors group by v),
    near as materialized (select a.first as hi, list(b.first) as below from firsts a join firsts b on b.first < a.first and list_dot_product(a.v, b.v) / ((a.l + 1e-9) * (b.l + 1e-9)) >= 0.95 group by a.first),
    step as materialized (select hi, below, row_number() over (order by hi) as k from near),
    scan as (select 0::bigint as k, null::bigint as hi, null::bigint as leader, []::bigint[] as led
      union all select p.k, p.hi, coalesce(list_min(list_filter(p.below, lambda x: not list_contains(s.led, x))), p.hi),
        case when len(list_filter(p.below, lambda x: not list_contains(s.led, x))) > 0 then list_append(s.led, p.hi) else s.led end from scan s join step p on p.k = s.k + 1),
    follow as (select hi, leader from scan where k > 0),
    member as (select n, name, canon, type, n_mentions, coalesce(leader, first) as leader from vectors join firsts using (v) left join follow on hi = first)
    select first(canon order by n) as canon, first(name order by length(name) desc, n) as name, first(type order by n) as type, sum(n_mentions)::bigint as n_mentions
    from member group by leader)""")
def _(spark, d):
    merged = resolve.merge_entities(extract.mentions(extract.chunk(_table(spark, d, "documents"))))
    folder = workspace(spark, "resolved")
    merged = materialize(merged, folder, "merged")
    whole = resolve.merge_similar(merged, _letters, folder)
    return whole.select("canon", "name", "type", "n_mentions")


@query("edge_ingest", "select source, type, target, evidence from relation")
def _(spark, d):
    return stored(spark, d).relation


def _grown(spark, d) -> str:
    """All documents, streamed into a store in four batches, of as many files as the table has splits."""
    folder = workspace(spark, "grown")
    docs = _table(spark, d, "documents").select("doc_id", "text", "source")
    parts = max(4, docs.rdd.getNumPartitions())
    docs.repartition(parts, "doc_id").write.parquet(f"{folder}/in")
    ingest.ingest(spark, f"{folder}/in", "doc_id long, text string, source string", f"{folder}/store", f"{folder}/offsets", files=-(-parts // 4)).awaitTermination()
    return f"{folder}/store"


@query("stream_entities", "select canon, name, type, description, doc_id, idx::bigint as idx, n_mentions::bigint as n_mentions from entity")
def _(spark, d):
    return ingest.merged_entities(spark, _grown(spark, d)).drop("first_place")


@query("stream_edges", "select source, type, target, evidence from relation")
def _(spark, d):
    return ingest.merged_relations(spark, _grown(spark, d))


@query("flat_entity_index", "select key, name, type, n_chunks::bigint as n_chunks from flat_index")
def _(spark, d):
    return resolve.flat_index(extract.mentions(extract.chunk(_table(spark, d, "documents"))))


@query("flat_postings", "select lower(name) as key, doc_id, idx::bigint as idx from mention where name <> ''")
def _(spark, d):
    return resolve.flat_postings(extract.mentions(extract.chunk(_table(spark, d, "documents"))))


@query("prompt_budget", """select batch, count(*)::bigint as n_entities, md5(string_agg(line, chr(10) order by n)) as listing_md5 from (
    select *, min(case when used + length(line) > 6000 then n end) over (partition by batch) as cut from (
      select *, coalesce(sum(length(line) + 1) over (partition by batch order by n rows between unbounded preceding and 1 preceding), 0) as used from (
        select n, (n // 25)::bigint as batch, '- ' || name || ' [' || type || ']: ' || substr(description, 1, 80) as line from numbered))) where cut is null or n < cut group by batch""")
def _(spark, d):
    merged = resolve.merge_entities(extract.mentions(extract.chunk(_table(spark, d, "documents"))))
    return concepts.entity_prompt(merged, workspace(spark, "budget")).select(F.col("batch").cast("long").alias("batch"), "n_entities", F.md5("listing").alias("listing_md5"))


# ---- vectors ----


@query("topk_cosine", """select query, label, vec_id, similarity, rank::int as rank from (select *, row_number() over (partition by query, label order by similarity desc, vec_id) as rank from (
    select query, label, vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)) + 1e-9), 6) as similarity
    from (select vec_id, label, embedding::double[] as v from embeddings), (select vec_id as query, embedding::double[] as q from embeddings where vec_id % 100 = 0))) where rank <= 5""", plain=True)
def _(spark, d):
    # the stated queries: ids divisible by 100, against all rows
    rows = _table(spark, d, "embeddings")
    found = similar.top_pairs(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", "label")
    return found.select("query", "label", F.col("id").alias("vec_id"), "similarity", "rank")


@query("index_topk", """select query, id, similarity, rank::int as rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from (
    select q.vec_id as query, r.vec_id as id, round(list_dot_product(r.v, q.v) / ((sqrt(list_dot_product(r.v, r.v)) + 1e-9) * (sqrt(list_dot_product(q.v, q.v)) + 1e-9)), 6) as similarity
    from (select vec_id, embedding::double[] as v from embeddings) r, (select vec_id, embedding::double[] as v from embeddings where vec_id % 100 = 0) q)) where rank <= 10""", plain=True)
def _(spark, d):
    # the stated queries: ids divisible by 100, against all rows
    rows = _table(spark, d, "embeddings")
    made = index.VectorIndex.build(rows, "vec_id", "embedding", workspace(spark, "index"))
    return made.search(rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, exact=True).withColumnRenamed("qid", "query")


@query("l2_normalise", "select vec_id, list_transform(embedding, lambda x: round(x::double / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9), 6)) as unit from embeddings", plain=True)
def _(spark, d):
    unit = V.normalised(F.col("embedding"))
    return _table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda x: V.rounded(x, 6)).alias("unit"))


@query("similar_pairs", """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 5) as similarity
    from (select vec_id, embedding::double[] as v from embeddings) a join (select vec_id, embedding::double[] as v from embeddings) b
    on a.vec_id < b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.35""", plain=True)
def _(spark, d):
    return similar.similar_pairs(_table(spark, d, "embeddings"), "vec_id", "embedding", 0.35).select("a", "b", V.rounded(F.col("similarity"), 5).alias("similarity"))


@query("dedup_leaders", """with recursive v as (select vec_id, embedding::double[] as e from embeddings),
    near as (select a.vec_id as id, list(b.vec_id) as below from v a join v b on b.vec_id < a.vec_id and list_cosine_similarity(a.e, b.e) >= 0.35 group by a.vec_id),
    place as (select vec_id as id, below, row_number() over (order by vec_id) as n from v left join near on near.id = v.vec_id),
    scan as (
      select 0::bigint as n, null::bigint as id, null::bigint as leader, []::bigint[] as leads
      union all select p.n, p.id, coalesce(list_min(list_intersect(p.below, s.leads)), p.id),
        case when len(coalesce(list_intersect(p.below, s.leads), [])) = 0 then list_append(s.leads, p.id) else s.leads end from scan s join place p on p.n = s.n + 1)
    select id, leader from scan where n > 0""", plain=True)
def _(spark, d):
    rows = _table(spark, d, "embeddings")
    return resolve.led(rows, "vec_id", "embedding", 0.35, workspace(spark, "leaders"))


@query("baseline_retrieve", "select qid, chunk_id, similarity, rank::int as rank from top_chunk where rank <= 5")
def _(spark, d):
    return retrieve.top_chunks(questions(spark, d), stored(spark, d).chunk)


# ---- concepts and communities ----


@query("concept_drafts", "select concept, member, place::int as place from draft")
def _(spark, d):
    # all merged entities
    merged = resolve.merge_entities(extract.mentions(extract.chunk(_table(spark, d, "documents"))))
    return concepts.draft_batches(merged, workspace(spark, "drafts"))


@query("concept_members", "select concept, entity from concept_member")
def _(spark, d):
    return stored(spark, d).concept_member


@query("concept_overlap", "select a, b, weight::bigint as weight from overlap")
def _(spark, d):
    return concepts.overlap(stored(spark, d).concept_member)


@query("community_components", "select concept, root from label")
def _(spark, d):
    members = stored(spark, d).concept_member
    return community.components(members.select("concept").distinct(), concepts.overlap(members), workspace(spark, "components"))


# Customers of a nation are linked by six maps of their ranks to one another, nations by every tenth rank: from 100
# customers on that is one component, whose best communities are the nations.
_RANKED = "select c_nationkey as g, row_number() over (partition by c_nationkey order by c_custkey) - 1 as r, count(*) over (partition by c_nationkey) as m from customer"
_LINKED = f"""ranked as ({_RANKED}), links as (select distinct least(a, b) as a, greatest(a, b) as b from (
      select g || '-' || r as a, g || '-' || ((r * k + k) % m) as b from ranked, unnest([3, 5, 7, 11, 13, 17]) as u(k)
      union all select g || '-' || r, x.g2 || '-' || r from ranked join (select distinct g as g1, (g + 1) % 25 as g2 from ranked) x on x.g1 = g where r % 10 = 9 and (x.g2, r) in (select (g, r) from ranked)) where a <> b),
    linked as (select a as v, b as u from links union all select b, a from links), planted as (select g || '-' || r as id, g, min(g || '-' || r) over (partition by g) as root from ranked)"""


def _linked(spark, d) -> tuple[DataFrame, DataFrame]:
    """(concept) and (a, b, weight) of the graph of customers."""
    nation = Window.partitionBy("c_nationkey")
    rows = _table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.row_number().over(nation.orderBy("c_custkey")) - 1).alias("r"), F.count(F.lit(1)).over(nation).alias("m"))
    rows = materialize(rows, workspace(spark, "linked"), "ranked")
    name = lambda g, r: F.concat_ws("-", g.cast("string"), r.cast("string"))
    inner = rows.withColumn("k", F.explode(F.array(*map(F.lit, (3, 5, 7, 11, 13, 17))))).select(name(F.col("g"), F.col("r")).alias("a"), name(F.col("g"), (F.col("r") * F.col("k") + F.col("k")) % F.col("m")).alias("b"))
    ends = rows.filter("r % 10 = 9").select("g", "r")
    # ranks are few bytes in files, and many in a broadcast
    outer = ends.join(rows.select(((F.col("g") + 24) % 25).alias("g"), "r", F.col("g").alias("after")).hint("merge"), ["g", "r"]).select(name(F.col("g"), F.col("r")).alias("a"), name(F.col("after"), F.col("r")).alias("b"))
    edges = inner.unionByName(outer).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return rows.select(name(F.col("g"), F.col("r")).alias("concept")), edges.withColumn("weight", F.lit(1))


_FOUND: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _found(spark, d) -> tuple[DataFrame, DataFrame]:
    """The communities that are found in the graph of customers, and its edges; found once a table."""
    key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/customer.parquet"))
    if key not in _FOUND:
        folder = workspace(spark, "detect")
        nodes, edges = _linked(spark, d)
        edges = materialize(edges, folder, "links")
        _FOUND[key] = materialize(community.detect(nodes, edges, f"{folder}/rounds", few=0), folder, "found"), edges
    return _FOUND[key]


@query("community_detect", f"with {_LINKED} select id as concept, root from planted", plain=True)
def _(spark, d):
    return _found(spark, d)[0]


@query("community_modularity", f"""with {_LINKED} select count(*) as edges, round(sum(case when x.g = y.g then 1 else 0 end) / count(*) - (select sum(n * n) from (
      select count(*) as n from linked join planted on id = v group by root)) / (4.0 * count(*) * count(*)), 6)::double as modularity
    from links join planted x on x.id = a join planted y on y.id = b""", plain=True)
def _(spark, d):
    labels, edges = _found(spark, d)
    return community.modularity(labels, edges).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


# in one piece: from its smallest member every member of a community is reached inside it
@query("community_connected", f"""with recursive {_LINKED}, walk(root, id) as (select distinct root, root from planted
      union select w.root, u from walk w join linked on v = w.id join planted p on p.id = u and p.root = w.root)
    select p.root, count(*) as members, (select count(*) from walk w where w.root = p.root) as reached from planted p group by p.root""", plain=True)
def _(spark, d):
    labels, edges = _found(spark, d)
    named = labels.select(F.col("concept").alias("id"), F.col("root").alias("c"))
    parts = leiden.connected(named, edges, workspace(spark, "connected")).join(named.hint("merge"), "id")
    return parts.groupBy(F.col("c").alias("root")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("root") == F.col("c")).alias("reached"))


@query("community_members", "select community, name, n_concepts::bigint as n_concepts, array_to_string(members, ', ') as members, summary from community")
def _(spark, d):
    g = stored(spark, d)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "entity"))), lambda x: x.entity), ", ")
    whole = g.community_member.groupBy("community").agg(listed.alias("members"))
    return g.community.select("community", "name", "n_concepts", "summary").join(whole, "community").select("community", "name", "n_concepts", "members", "summary")


@query("community_member_pages", f"""select community, (place // {community.PAGE})::bigint as page, place::bigint as place, entity from (
    select community, unnest(members) as entity, generate_subscripts(members, 1) - 1 as place from community)""")
def _(spark, d):
    return stored(spark, d).community_member


# ---- retrieval ----


def _retrieved(spark, d) -> retrieve.Retrieval:
    return retrieve.Retrieval(questions(spark, d), stored(spark, d), folder=workspace(spark, "retrieval"))


@query("match_communities", "select qid, community, similarity, rank::int as rank from matched")
def _(spark, d):
    return retrieve.match_communities(questions(spark, d), stored(spark, d))


@query("drill_concepts", "select qid, concept, community, relevance, rank::int as rank from drilled")
def _(spark, d):
    return _retrieved(spark, d).concepts


@query("seed_entities", "select qid, name, from_concept from seed")
def _(spark, d):
    return retrieve.seeds(_retrieved(spark, d).concepts, stored(spark, d)).select("qid", "name", "from_concept")


@query("bfs_hops", "select qid, name, hop::int as hop, reached_via from reached")
def _(spark, d):
    return _retrieved(spark, d).reached.select("qid", "name", "hop", "reached_via")


@query("collect_entities", "select qid, name, type, from_concept, hop::int as hop, reached_via, relevance, rank::int as rank from collected")
def _(spark, d):
    return _retrieved(spark, d).entities.drop("description")


@query("edges_inner", "select qid, source, type, target, evidence from touched where inner_edge")
def _(spark, d):
    return retrieve.inner_edges(_retrieved(spark, d).entities, stored(spark, d))


@query("edges_boundary", "select qid, source, type, target, evidence from outer_edge")
def _(spark, d):
    return retrieve.boundary_edges(_retrieved(spark, d).entities, stored(spark, d))


@query("relationships", "select qid, place::int as place, source, type, target, evidence from edge")
def _(spark, d):
    return _retrieved(spark, d).relationships


@query("relationship_chain", "select qid, step::bigint as step, source, type, target, evidence from chain_edge")
def _(spark, d):
    return retrieve.chained(_retrieved(spark, d).relationships)


@query("bridging_entities", "select qid, name from bridge")
def _(spark, d):
    return _retrieved(spark, d).bridging


@query("diverse_topk", "select qid, chunk_id, doc_id, idx::bigint as idx, similarity, source, choice::int as choice from context")
def _(spark, d):
    return _retrieved(spark, d).context


@query("context_chunks", "select qid, count(*)::bigint as n_chunks, md5(string_agg(text, chr(10) order by c.doc_id, c.idx, text)) as chunks_md5 from context c join chunk using (chunk_id) group by qid")
def _(spark, d):
    rows = retrieve.in_reading_order(_retrieved(spark, d).context, stored(spark, d))
    return rows.select("qid", F.size("chunks").cast("long").alias("n_chunks"), F.md5(F.array_join("chunks", "\n")).alias("chunks_md5"))


_COUNT = "coalesce((select count(*) from {t} t where t.qid = q.qid), 0)::bigint as {n}"
_PATH = [("matched", "n_communities"), ("drilled", "n_concepts"), ("collected", "n_entities"), ("edge", "n_relationships"), ("bridge", "n_bridging"), ("context", "n_chunks")]


@query("retrieval_path", "select qid, " + ", ".join(_COUNT.format(t=t, n=n) for t, n in _PATH) + " from question q")
def _(spark, d):
    return _retrieved(spark, d).path


@query("answer_prompts", """select qid, 'Relationships:' || chr(10) || coalesce(listing, '(none)') || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(shown, '') || chr(10) || chr(10) || 'Question: ' || query as prompt
    from question left join (select qid, string_agg((step + 1) || '. ' || source || ' --[' || type || ']--> ' || target || case when evidence <> '' then ' | ' || substr(evidence, 1, 300) else '' end, chr(10) order by step) as listing
      from chain_edge where step < 20 group by qid) using (qid)
    left join (select qid, string_agg(case when length(text) > 1200 then substr(text, 1, 1200) || '...' else text end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by c.doc_id, c.idx, text) as shown
      from context c join chunk using (chunk_id) group by qid) using (qid)""")
def _(spark, d):
    store, found = stored(spark, d), _retrieved(spark, d)
    lines = retrieve.relationship_lines(retrieve.chained(found.relationships))
    return retrieve.prompts(questions(spark, d), lines, retrieve.in_reading_order(found.context, store))


# ---- flat pipeline ----


@query("baseline_prompts", """select qid, 'Context:' || chr(10) || coalesce(shown, '') || chr(10) || chr(10) || 'Question: ' || query as prompt from question
    left join (select qid, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as shown from top_chunk join chunk using (chunk_id) where rank <= 5 group by qid) using (qid)""")
def _(spark, d):
    store, asked = stored(spark, d), questions(spark, d)
    texts = retrieve.by_rank(retrieve.top_chunks(asked, store.chunk), store)
    return retrieve.formed("baseline", asked, None, texts)


def _flat(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    store = stored(spark, d)
    return questions(spark, d), flat.mentioned(questions(spark, d), store.flat_entity), store.mention


@query("entity_match", "select qid, key, name from flat_match")
def _(spark, d):
    return _flat(spark, d)[1].select("qid", "key", "name")


@query("flat_context", """select qid, chunk_id, phase::int as phase, place::int as place from (select *, row_number() over (partition by qid order by phase, o1, o2) as place from (
    select qid, chunk_id, 0 as phase, rank as o1, 0 as o2 from top_chunk
    union all select distinct qid, doc_id || '_chunk_' || idx, 1, doc_id, idx from flat_match f join mention m on lower(m.name) = f.key
      where (qid, doc_id || '_chunk_' || idx) not in (select (qid, chunk_id) from top_chunk))) where place <= 10""")
def _(spark, d):
    asked, matched, found = _flat(spark, d)
    return flat.merged_context(retrieve.top_chunks(asked, stored(spark, d).chunk, DEFAULT.flat_top_k), matched, resolve.flat_postings(found))


@query("flat_relationships", """select qid, place::int as place, source, target, type from (select *, row_number() over (partition by qid order by doc_id, idx, pos) as place from (
    select distinct qid, doc_id, idx, pos, source, target, type from raw_relation r join (select distinct qid, lower(name) as n from flat_match) m on m.n = lower(r.source) or m.n = lower(r.target))) where place <= 10""")
def _(spark, d):
    _asked, matched, _found = _flat(spark, d)
    return flat.matched_relationships(matched, stored(spark, d).claim)


# ---- evaluation ----


@query("avg_relevance", "select qid, round_even(avg(similarity), 4)::double as avg_relevance_score, count(*)::bigint as n_chunks from (select * from top_chunk where rank <= 5) group by qid")
def _(spark, d):
    return evaluate.average_relevance(retrieve.top_chunks(questions(spark, d), stored(spark, d).chunk))


@query("judge_ratio", """select doc_id, case doc_id % 3 when 0 then least(1.0, quality + 0.25) when 1 then (quality + toxic) / 2.0 else 0.0 end::double as score from labels""", plain=True)
def _(spark, d):
    k, q, t = F.col("doc_id") % 3, F.col("quality"), F.col("toxic")
    yes = lambda c: F.when(c == 1, "true").otherwise("false")
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n{"claims": [], "score": '), (q + 0.25).cast("string"), F.lit("}\n```")))
        .when(k == 1, F.concat(F.lit('{"claims": [{"claim": "a", "supported": '), yes(q), F.lit('}, {"claim": "b", "supported": '), yes(t), F.lit("}]}")))
        .otherwise(F.lit("no JSON here"))
    )
    return _table(spark, d, "labels").select("doc_id", evaluate.judge_score(reply).alias("score"))


_METRIC_SQL = "select event_type as category, (event_id % 7) / 7::double as answer_relevancy, (event_id % 5) / 7::double as faithfulness, (user_id % 3) / 3::double as context_recall, (user_id % 9) / 11::double as avg_relevance_score, event_id from events"


def _metrics(events: DataFrame) -> DataFrame:
    # thirds, sevenths and elevenths: their means are no ties of decimal rounding, which engines break differently
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(F.col("event_type").alias("category"), "event_id", (e % 7 / 7.0).alias("answer_relevancy"), (e % 5 / 7.0).alias("faithfulness"), (u % 3 / 3.0).alias("context_recall"), (u % 9 / 11.0).alias("avg_relevance_score"))


def _means(where: str = "") -> str:
    means = ", ".join(f"round_even(avg({m}), 4)::double as {m}" for m in evaluate.METRICS)
    return f"select coalesce(category, 'overall') as category, count(*)::bigint as n, {means} from ({_METRIC_SQL}){where} group by grouping sets ((category), ())"


@query("metric_rollup", _means(), plain=True)
def _(spark, d):
    return evaluate.roll_up(_metrics(_table(spark, d, "events")))


@query("metric_delta", f"""with a as (unpivot (select * exclude (n) from ({_means(" where event_id % 2 = 0")})) on answer_relevancy, faithfulness, context_recall, avg_relevance_score into name metric value v),
    b as (unpivot (select * exclude (n) from ({_means(" where event_id % 2 = 1")})) on answer_relevancy, faithfulness, context_recall, avg_relevance_score into name metric value v)
    select category, metric, coalesce(a.v, 0) as baseline, coalesce(b.v, 0) as graph, round(coalesce(b.v, 0) - coalesce(a.v, 0), 4) as delta, round(coalesce(b.v, 0) - coalesce(a.v, 0), 4) > 0 as better
    from a full outer join b using (category, metric)""", plain=True)
def _(spark, d):
    rows = _metrics(_table(spark, d, "events"))
    return evaluate.compare(evaluate.roll_up(rows.filter("event_id % 2 = 0")), evaluate.roll_up(rows.filter("event_id % 2 = 1")))


# ---- explain and export ----


@query("trace_stages", f"""select qid, stage, rank::int as rank, item, score::double as score, flag, repeat('#', floor(greatest(score, 0) * 30)::int) || repeat('.', 30 - floor(greatest(score, 0) * 30)::int) as bar from (
    select qid, '1 communities' as stage, rank, community as item, similarity as score,
      case when rank <= 3 and (similarity >= 0.35 or rank = 1) then 'SELECTED' when similarity < 0.35 then 'BELOW THRESHOLD' else 'DROPPED' end as flag
    from (select *, row_number() over (partition by qid order by similarity desc, community) as rank from (select qid, community, {cosine("embedding", "q")} as similarity from community, question))
    union all select qid, '2 concepts', rank, concept, relevance, case when rank <= 10 then 'SELECTED' else 'DROPPED' end from t_concept
    union all select qid, '3 entities', rank, way, relevance, case when rank <= 25 then 'SELECTED' else 'DROPPED' end from t_entity
    union all select qid, '4 chunks', rank, chunk_id || ' (via ' || n || ' entities)', 0, case when rank <= 6 then 'READ' else 'LISTED' end from t_chunk)""")
def _(spark, d):
    return explain.trace(questions(spark, d), stored(spark, d), folder=workspace(spark, "trace"))


@query("path_lines", """select qid, section::int as section, place::int as place, line from (
    select qid, 1 as section, rank as place, '[' || repeat('#', floor(greatest(similarity, 0) * 20)::int) || repeat('.', 20 - floor(greatest(similarity, 0) * 20)::int) || '] ' || printf('%.3f', similarity) || '  ' || name as line
      from matched join community using (community)
    union all select qid, 2, rank, '* ' || concept || ' (relevance=' || printf('%.3f', relevance) || ')' from drilled
    union all select qid, 3, 1, (select count(*) from collected c where c.qid = q.qid) || ' entities, ' || (select count(*) from context c where c.qid = q.qid) || ' chunks, ' || (select count(*) from edge c where c.qid = q.qid) || ' relationships' from question q
    union all select qid, 4, place, '> ' || reached_via from (select *, row_number() over (partition by qid order by rank) as place from collected where reached_via is not null) where place <= 4)""")
def _(spark, d):
    return retrieve.path_lines(_retrieved(spark, d))


@query("hop_counts", "select qid, count(*) filter (hop = 0)::bigint as n_seeds, count(*) filter (hop > 0)::bigint as n_found from reached group by qid")
def _(spark, d):
    return explain.hop_counts(_retrieved(spark, d).reached)


@query("hierarchy_text", """select community, name || chr(10) || string_agg('  * ' || concept || chr(10) || lines, chr(10) order by concept) as tree
    from community_concept join community using (community) join (select concept, string_agg('    - ' || entity, chr(10) order by entity) as lines from concept_member group by concept) using (concept) group by community, name""")
def _(spark, d):
    return explain.hierarchy(stored(spark, d))


@query("hierarchy_lines", """select community, '' as concept, '' as entity, name as line from community where community in (select community from community_concept)
    union all select community, concept, '', '  * ' || concept from community_concept
    union all select community, concept, entity, '    - ' || entity from community_concept join concept_member using (concept)""")
def _(spark, d):
    return explain.hierarchy_lines(stored(spark, d))


@query("type_counts", "select type, count(*)::bigint as n from entity group by type")
def _(spark, d):
    return explain.type_counts(stored(spark, d).entity)


_COLOUR = "case coalesce(type, 'OTHER') " + " ".join(f"when '{k}' then '{v}'" for k, v in explain.COLOURS.items()) + " else '#7f8c8d' end"


@query("export_nodes", f"""select 'comm_' || community as node_id, name as label, 0 as level, '#c0392b' as colour from community
    union all select 'concept_' || concept, concept, 1, '#2980b9' from concept
    union all select distinct 'entity_' || name, name, 2, {_COLOUR} from entity""")
def _(spark, d):
    return explain.nodes(stored(spark, d))


@query("export_edges", """select 'comm_' || community as source_id, 'concept_' || concept as target_id, 'contains' as label from community_concept
    union all select 'concept_' || concept, 'entity_' || entity, 'instantiated by' from concept_member
    union all select 'entity_' || source, 'entity_' || target, lower(replace(type, '_', ' ')) from relation""")
def _(spark, d):
    return explain.edges(stored(spark, d))


_SUPPLY = "select distinct 's' || l_suppkey as source, 'p' || l_partkey as target, case when l_quantity > 25 then 'BULK' else 'RETAIL' end as type from lineitem"


def _supply(spark, d) -> DataFrame:
    rows = _table(spark, d, "lineitem")
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.when(F.col("l_quantity") > 25, "BULK").otherwise("RETAIL").alias("type")).distinct()


@query("neighbourhood", f"""with e as ({_SUPPLY}), b as (select distinct source as u, target as v from e union select target, source from e),
    s as (select distinct 'p' || p_partkey as seed from part where p_partkey % 100 = 0),
    h1 as (select distinct seed, v as node from s join b on u = seed), h2 as (select distinct seed, v as node from h1 join b on u = node)
    select seed, node, min(hop)::int as hop from (select seed, seed as node, 0 as hop from s union all select seed, node, 1 from h1 union all select seed, node, 2 from h2) group by seed, node""", plain=True)
def _(spark, d):
    # the stated seeds: parts whose key is divisible by 100
    seeds = _table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("seed")).distinct()
    return graph.neighbourhood(_supply(spark, d), seeds)


@query("highlight_filter", f"select distinct unnest([source, target]) as name from ({_SUPPLY}) where type = 'BULK'", plain=True)
def _(spark, d):
    return graph.ends_where(_supply(spark, d), "type", ["BULK"])


@query("induced_edges", """select source, type, target, evidence from relation where source in (select name from entity where type in ('PERSON', 'EVENT')) and target in (select name from entity where type in ('PERSON', 'EVENT'))""")
def _(spark, d):
    store = stored(spark, d)
    return graph.induced(store.relation, graph.nodes_where(store.entity, "type", ["PERSON", "EVENT"]))


@query("document_chunks", "select doc_id, count(*)::bigint as n_chunks from chunk0 group by doc_id")
def _(spark, d):
    return graph.has_chunk(stored(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("type_filter", "select name from entity where type in ('PERSON', 'EVENT')")
def _(spark, d):
    return graph.nodes_where(stored(spark, d).entity, "type", ["PERSON", "EVENT"])


@query("graph_stats", """select (select count(*) from documents) as documents, (select sum(length(text)) from documents)::bigint as characters, (select count(*) from chunk0) as chunks, (select count(*) from entity) as entities,
    (select count(*) from relation) as relationships, (select count(*) from concept) as concepts, (select count(*) from community) as communities,
    (ceil((select count(*) from chunk0) / 3) + ceil((select count(*) from entity) / 25) + (select count(*) from community))::bigint as llm_calls""")
def _(spark, d):
    return graph.statistics(stored(spark, d), _table(spark, d, "documents"))


@query("call_rate_60s", "select event_id, user_id, calls::bigint as calls, calls > 28 as over from (select *, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as calls from events)", plain=True)
def _(spark, d):
    return client.call_rate(_table(spark, d, "events"))


@query("calls_per_minute", "select date_trunc('minute', ts)::timestamp as minute, user_id, count(*)::bigint as calls from events group by 1, 2", plain=True)
def _(spark, d):
    return ingest.call_rates(_table(spark, d, "events"))
