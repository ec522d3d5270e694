"""Operators with an order to keep, against small sequential versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import vector as V
from loam.operators import adjacency, client, community, concepts, evaluate, extract, flat, graph, leiden, resolve, retrieve, similar
from loam.store import materialize, workspace

OVERLAP = [("c0", "c2", 1), ("c0", "c3", 1), ("c0", "c4", 1), ("c1", "c3", 1), ("c4", "c5", 1), ("c6", "c7", 3)]


def concept_table(spark):
    return spark.createDataFrame([(f"c{k}" if k < 10 else f"d{k}",) for k in range(13)], "concept string")


def edge_table(spark, rows=OVERLAP):
    return spark.createDataFrame(rows, "a string, b string, weight long")


def test_components_and_modularity(spark):
    labels = community.components(concept_table(spark), edge_table(spark), workspace(spark, "t"))
    assert labels.select("root").distinct().count() == 7
    assert community.modularity(labels, edge_table(spark)).first()[0] == pytest.approx(0.277778)


@pytest.mark.parametrize("few", [0, 100])
def test_modularity_reaches_the_optimum_and_communities_are_connected(spark, few):
    labels = community.detect(concept_table(spark), edge_table(spark), workspace(spark, "t"), few=few)
    assert labels.count() == 13
    # 0.402778 is the best there is; rounds may stop a join short of it
    assert community.modularity(labels, edge_table(spark)).first()[0] >= 0.402778 - (0.01 if few == 0 else 1e-6)
    named = labels.select(F.col("concept").alias("id"), F.col("root").alias("c"))
    parts = leiden.connected(named, edge_table(spark), workspace(spark, "t"))
    assert parts.exceptAll(named).count() == 0  # each is one part, named by its smallest member


def test_rounds_come_close_to_joining_the_best_pair_each_time(spark):
    """A graph in one piece with rings of ten, a hub over all of them and edges at random."""
    rng = random.Random(8)
    links = {(f"n{g}{i}", f"n{g}{(i + j) % 10}") for g in range(9) for i in range(10) for j in (1, 2, 3)} | {("hub", f"n{g}{i}") for g in range(9) for i in range(10)}
    links |= {(f"n{rng.randrange(9)}{rng.randrange(10)}", f"n{rng.randrange(9)}{rng.randrange(10)}") for _ in range(40)}
    rows = sorted({(min(e), max(e)) for e in links if e[0] != e[1]})
    edges = spark.createDataFrame([(a, b, 1) for a, b in rows], "a string, b string, weight long")
    names = spark.createDataFrame([(n,) for n in sorted({n for e in rows for n in e})], "concept string")
    scores = [community.modularity(community.detect(names, edges, workspace(spark, "t"), few=few), edges).first()[0] for few in (0, 10_000)]
    assert scores[0] >= scores[1] - 0.01
    assert community.components(names, edges, workspace(spark, "t")).select("root").distinct().count() == 1


def test_rounds_end_when_no_node_would_move(spark, monkeypatch):
    """However soon the first rounds stop, no node is left in a community that it would leave: a stray one also names it."""
    monkeypatch.setattr(leiden, "STILL", 0.9)
    rng = random.Random(5)
    rows = {(f"{g}-{i}", f"{g}-{rng.randrange(40)}") for g in range(6) for i in range(40) for _ in range(5)}
    rows |= {(f"{g}-{i}", f"{(g + 1) % 6}-{i}") for g in range(6) for i in range(0, 40, 4)}
    edges = spark.createDataFrame(sorted({(min(e), max(e)) for e in rows if e[0] != e[1]}), "a string, b string").withColumn("weight", F.lit(1))
    names = spark.createDataFrame([(f"{g}-{i}",) for g in range(6) for i in range(40)], "concept string")
    found = community.detect(names, edges, workspace(spark, "t"), few=0)
    assert {(r.concept, r.root) for r in found.collect()} == {(f"{g}-{i}", f"{g}-0") for g in range(6) for i in range(40)}


def linked_groups(spark, groups, size):
    """(concept) and (a, b, weight): groups of nodes at random links inside, and few between."""
    rng = random.Random(11)
    rows = {(f"{g}-{i}", f"{g}-{rng.randrange(size)}") for g in range(groups) for i in range(size) for _ in range(5)}
    rows |= {(f"{g}-{i}", f"{(g + 1) % groups}-{i}") for g in range(groups) for i in range(0, size, 10)}
    edges = spark.createDataFrame(sorted({(min(e), max(e)) for e in rows if e[0] != e[1]}), "a string, b string").withColumn("weight", F.lit(1))
    return spark.createDataFrame([(f"{g}-{i}",) for g in range(groups) for i in range(size)], "concept string"), edges


def test_large_graphs_grow_together_first_and_single_nodes_move_until_none_would(spark, monkeypatch):
    monkeypatch.setattr(leiden, "GROWN", 0)
    monkeypatch.setattr(leiden, "HELD", 0)  # nothing goes to every task
    names, edges = linked_groups(spark, 8, 150)
    seen = []
    monkeypatch.setattr(leiden, "_contracted", lambda edges, parts, f=leiden._contracted: seen.append((parts.count(), parts.select("c").distinct().count())) or f(edges, parts))
    found = community.detect(names, edges, workspace(spark, "t"), few=0)
    assert {(r.concept, r.root) for r in found.collect()} == {(f"{g}-{i}", f"{g}-0") for g in range(8) for i in range(150)}
    assert seen[0][0] == 1200 and 4 * seen[0][1] < seen[0][0]  # the first level is far smaller than the graph


def test_parts_of_communities_grow_as_they_are_reached(spark, monkeypatch, tmp_path):
    """Two long paths, a star and a lone node in one community, a path in another."""
    edges = [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [(f"q{k:03}", f"q{k + 1:03}") for k in range(40)] + [("s", f"t{k:03}") for k in range(30)] + [("p005", "x0"), ("x0", "x1")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    labels = spark.createDataFrame([(n, "x" if n[0] == "x" else "all") for n in nodes], "id string, c string")
    rows = spark.createDataFrame(edges, "a string, b string")
    want = sorted(map(tuple, leiden.connected(labels, rows, f"file://{tmp_path}/plain").collect()))
    monkeypatch.setattr(leiden, "GROWN", 0)
    assert sorted(map(tuple, leiden.connected(labels, rows, f"file://{tmp_path}/grown").collect())) == want
    assert len({root for _, root in want}) == 5


def test_no_join_with_labels_is_a_broadcast(spark, tmp_path):
    """Labels of many nodes take few bytes in files."""
    rows = spark.range(100).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("concept"), F.lit("n0000").alias("root"))
    labels = materialize(rows, f"file://{tmp_path}", "labels")
    edges = materialize(spark.createDataFrame([("n0001", "n0002")], "a string, b string"), f"file://{tmp_path}", "edges")
    plan = community.modularity(labels, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_no_overlap_is_one_community(spark):
    few = spark.createDataFrame([("a",), ("b",), ("c",)], "concept string")
    labels = community.components(few, edge_table(spark, []), workspace(spark, "t"))
    assert {r.root for r in labels.collect()} == {"a"}


def greedy(n, pairs):
    out = {}
    for i in range(n):
        if i in out:
            continue
        out[i] = i
        for j in range(i + 1, n):
            if j not in out and (i, j) in pairs:
                out[j] = i
    return out


@pytest.mark.parametrize("few", [0, 5, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_leaders_equal_the_sequential_scan(spark, seed, few):
    rng = random.Random(seed)
    n = 14
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.2} | {(a, a + 1) for a in range(n - 1)}
    ids = spark.createDataFrame([(k,) for k in range(n)], "id long")
    rows = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {r.id: r.leader for r in resolve.leaders(rows, ids, workspace(spark, "t"), few).collect()}
    assert got == greedy(n, pairs)


@pytest.mark.parametrize("repeated", [False, True])
def test_leaders_of_vectors_meet_leaders_only(spark, tmp_path, monkeypatch, repeated):
    """Several rounds of blocks, two widths, copies, and rows without a sound vector; all pairs are made only where ids repeat."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=4 if k % 5 else 3).tolist() for k in range(90)]
    vectors[40], vectors[7], vectors[60], vectors[61] = vectors[1], None, [float("nan"), 1.0, 0.0, 0.0], []
    rows = [(3 * k, v) for k, v in enumerate(vectors)] + ([(30, vectors[11])] if repeated else [])
    unit = [(i, np.array(v) / (np.linalg.norm(v) + 1e-9)) for i, v in rows if v and not np.isnan(v).any()]
    near = {(a // 3, b // 3) for a, x in unit for b, y in unit if a < b and len(x) == len(y) and x @ y >= 0.7}
    if not repeated:
        monkeypatch.setattr(resolve, "similar_pairs", None)
        monkeypatch.setattr(similar.leaders, "__defaults__", (8,))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id // 3: r.leader // 3 for r in resolve.led(df, "vec_id", "embedding", 0.7, f"file://{tmp_path}").collect()}
    assert got == greedy(90, near)


def reference_chain(edges):
    by_source = {}
    for k, (s, _) in enumerate(edges):
        by_source.setdefault(s, []).append(k)
    starts = [s for s in by_source if s not in {t for _, t in edges}] or list(by_source)
    used, out = set(), []
    for at in starts:
        while True:
            free = [k for k in by_source.get(at, []) if k not in used]
            if not free:
                break
            used.add(free[0])
            out.append(free[0])
            at = edges[free[0]][1]
    return out + [k for k in range(len(edges)) if k not in used]


def test_chain_order():
    rng = random.Random(3)
    for _ in range(200):
        edges = [(rng.choice("abcde"), rng.choice("abcde")) for _ in range(rng.randint(0, 8))]
        if len(edges) > 1:
            assert retrieve.chain_order(edges) == reference_chain(edges)


def test_neighbourhood_grows_with_hops_and_knows_no_repeats(spark):
    relation = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("d", "c", "x"), ("e", "d", "x")], "source string, target string, type string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    one = {(r.node, r.hop) for r in graph.neighbourhood(relation, seeds, 1).collect()}
    two = {(r.node, r.hop) for r in graph.neighbourhood(relation, seeds, 2).collect()}
    assert one == {("a", 0), ("b", 1), ("c", 1)} and two == one | {("d", 2)}


def test_entity_merge_keeps_first_and_longest(spark):
    rows = [(1, 0, 0, "The Acme", "ORG", "x"), (1, 0, 1, "Acme (Inc)", "PERSON", "longer"), (1, 1, 0, "acme", "EVENT", "equal6"), (2, 0, 0, "!!", "ORG", "y")]
    found = spark.createDataFrame(rows, "doc_id long, idx long, pos long, name string, type string, description string")
    (r,) = resolve.merge_entities(found).collect()
    assert (r.canon, r.name, r.type, r.description, r.n_mentions) == ("acme", "Acme (Inc)", "ORG", "longer", 3)


def test_similar_entities_merge_in_entity_order(spark):
    # by angle: 0 absorbs 10 and leaves 25 (over 18 degrees away), which 10 would have taken; 25 absorbs 40
    angles = {"Alphas": 0, "Alphasy": 10, "Betasx": 25, "Betas": 40, "Gammas": 180}
    rows = [(n.lower(), n, "ORG", "seen" + " again" * (n == "Alphasy"), 1, 0, (1, 0, k), k + 1) for k, n in enumerate(angles)]
    schema = "canon string, name string, type string, description string, doc_id long, idx long, first_place struct<doc_id:long,idx:long,pos:long>, n_mentions long"
    angle = F.create_map(*[F.lit(x) for n, a in angles.items() for x in (n, float(a))])
    embed = lambda df: df.withColumn("name_vector", F.array(F.cos(F.radians(angle[F.col("name")])), F.sin(F.radians(angle[F.col("name")]))))
    entities = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(tuple(r) for r in resolve.merge_similar(entities, embed, workspace(spark, "t")).select("canon", "name", "description", "n_mentions").collect())
    assert got == [("alphas", "Alphasy", "seen again", 3), ("betasx", "Betasx", "seen", 7), ("gammas", "Gammas", "seen", 5)]


def test_resolve_members(spark):
    drafts = spark.createDataFrame([("c", "Alpha"), ("c", "beta"), ("c", "Gam"), ("d", "Alpha"), ("d", "zzz")], "concept string, member string")
    entities = spark.createDataFrame([("Alpha",), ("Beta",), ("Gamma",)], "name string")
    assert {tuple(r) for r in concepts.resolve_members(drafts, entities).collect()} == {("c", "Alpha"), ("c", "Beta"), ("c", "Gamma")}


def test_concepts_take_every_entity(spark):
    rows = [(f"k{k:02}", f"Name{k:02}", (k // 7, 0, k % 7)) for k in range(57)]
    entities = spark.createDataFrame(rows, "canon string, name string, first_place struct<doc_id:long,idx:long,pos:long>").repartition(5)
    want = {}
    for lo in range(0, 57, 25):
        batch = [r[1] for r in rows[lo : min(lo + 25, 57)]]
        for g in range(0, len(batch), 5):
            if g == 0 or len(batch[g:]) > 1:
                want[f"Theme {lo // 25 + 1}.{g // 5 + 1}"] = batch[g : g + 6]
    got = {}
    for r in concepts.draft_batches(entities, workspace(spark, "t")).orderBy("place").collect():
        got.setdefault(r.concept, []).append(r.member)
    assert got == want and {m for c in got.values() for m in c} == {r[1] for r in rows}


def test_a_graph_of_batched_concepts_holds_every_entity(spark):
    text = " ".join(f"Alpha{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    docs = spark.createDataFrame([(k, text, f"s{k}") for k in range(5)], "doc_id long, text string, source string")
    whole = graph.build(docs)
    assert whole.concept_member.select("entity").distinct().count() == whole.entity.count() == 64


def test_replies_align_by_segment(spark):
    list_reply = '[{"segment": 2, "entities": [{"name": "B"}]}, {"segment": 1, "entities": [{"name": "A"}], "relationships": []}]'
    rows = spark.createDataFrame([(1, 0, list_reply), (1, 1, '{"entities": [{"name": "C"}]}'), (2, 0, "no")], "doc_id long, batch long, reply string")
    got = {(r.doc_id, r.idx): [e.name for e in r.entities] for r in extract.parse_replies(rows).collect()}
    assert got[1, 0] == ["A"] and got[1, 1] == ["B"] and got[1, 3] == ["C"] and got[2, 0] == []


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = {(r.a, r.b) for r in similar.similar_pairs(df, "id", "v", 0.6).collect()}
    blocked = {(r.a, r.b) for r in similar.similar_pairs(df, "id", "v", 0.6, block_rows=7).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    brute = {(i, j) for i, x in rows for j, y in rows if i < j and dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 >= 0.6}
    assert whole == blocked == brute


def test_similar_pairs_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(similar, "PRODUCTS", 3)
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, None]), (5, None), (6, []), (None, [1.0, 0.0]), (7, [5.0, 0.0, 0.1]), (8, [0.0, 0.0]), (9, [1.0, float("nan")]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for block_rows in (None, 2):
        assert sorted((r.a, r.b) for r in similar.similar_pairs(df, "id", "v", 0.9, block_rows).collect()) == [(1, 2), (1, 2), (3, 7)]
    assert similar.similar_pairs(df.limit(0), "id", "v", 0.9).count() == 0


@pytest.mark.parametrize("threshold, pivots", [(0.95, 1), (0.95, 40), (0.3, 40), (-0.5, 9)])
def test_cells_and_rings_lose_no_pair_and_spare_most_products(spark, threshold, pivots):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(k, [x + rng.gauss(0, 0.15) for x in centres[k % 40]]) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= threshold), strict=True) if i < j and abs(sim[i, j] - threshold) > 1e-7}
    got = {(r.a, r.b) for r in similar.similar_pairs(df, "id", "v", threshold, 50, pivots).collect()}
    assert len(want) > 500 and want == {(a, b) for a, b in got if abs(sim[a, b] - threshold) > 1e-7}
    met = similar.dealt(df, "id", "v", threshold, workspace(spark, "t"), pivots, 50).groupBy(*similar.CELL, "part").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    products = met.agg(F.sum(F.col("h") * F.col("g"))).first()[0]
    if (threshold, pivots) == (0.95, 40):
        assert products < 600 * 600 / 8



def test_rows_that_no_ring_keeps_out_are_guests_of_blocks_not_of_rings(spark):
    """Vectors without clusters at a low threshold: every row may meet every other, so it goes to each block of rows once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    met = similar.dealt(df, "id", "v", 0.35, workspace(spark, "t"), 20, 400).groupBy(*similar.CELL, "part").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).collect()
    assert sum(r.h for r in met) == 1200 and max(r.h for r in met) <= 800
    assert sum(r.g for r in met) <= 4 * 1200
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.35, 1))
    got = [(r.a, r.b) for r in similar.similar_pairs(df, "id", "v", 0.35, 400, 20).collect()]
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 1000


def diverse(candidates, k):
    """The selection rule, read literally: candidates are (id, source) by falling similarity."""
    if len(candidates) <= k:
        return candidates[:k]
    groups = {}
    for c in candidates:
        groups.setdefault(c[1], []).append(c)
    chosen = [c for g in groups.values() for c in g[:2]]
    chosen += [c for c in candidates if c not in chosen]
    return chosen[:k]


@pytest.mark.parametrize("n,k", [(12, 10), (12, 4), (6, 10)])
def test_diversity(spark, n, k):
    from loam.config import Config

    rng = random.Random(n * k)
    rest = [0.0] * (V.DIM - 2)
    chunks = [(f"c{i:02}", 1, i, f"Title of source {rng.randint(0, 2)}\nx", [float(n - i), float(i * i + 1), *rest]) for i in range(n)]
    g = type("G", (), {})()
    g.chunk = spark.createDataFrame(chunks, "chunk_id string, doc_id long, idx long, text string, embedding array<double>")
    g.has_entity = g.chunk.select("chunk_id", F.lit("E").alias("entity"))
    asked = spark.createDataFrame([(1, [1.0, 0.0, *rest])], "qid long, q array<double>")
    names = spark.createDataFrame([(1, "E")], "qid long, name string")
    got = [r.chunk_id for r in retrieve.context(asked, names, g, Config(graph_top_k_chunks=k)).orderBy("choice").collect()]
    assert got == [c for c, _ in diverse([(c[0], c[3].split("\n")[0]) for c in chunks], k)]


def test_below_threshold_only_the_best_stands_in(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.5), (2, "b", 0.4), (2, "c", 0.1)], "qid long, k string, s double")
    got = {(r.qid, r.k) for r in retrieve.best(rows, "s", "k", 3, 0.35).collect()}
    assert got == {(1, "b"), (2, "a"), (2, "b")}


def test_judge_scores(spark):
    replies = ['{"score": 1.7}', '{"claims": [{"supported": true}, {"supported": false}]}', "none", '{"score": "x", "claims": []}']
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string")
    assert [x.s for x in rows.select("k", evaluate.judge_score(F.col("r")).alias("s")).orderBy("k").collect()] == [1.0, 0.5, 0.0, 0.0]


def test_roll_up_has_an_overall_row(spark):
    rows = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4), ("b", 0.3, 0.2, 0.1, 0.0)], "category string, answer_relevancy double, faithfulness double, context_recall double, avg_relevance_score double")
    got = {r.category: r for r in evaluate.roll_up(rows).collect()}
    assert got["overall"].n == 2 and got["overall"].answer_relevancy == pytest.approx(0.2)


def test_rate_limiter_waits_for_the_window():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = client.RateLimiter(4, tasks=2, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == [61.0]


def test_call_retries_then_gives_up():
    calls = []

    def broken(prompt):
        calls.append(prompt)
        raise OSError

    assert client.call(broken, "p", client.RateLimiter(100), attempts=3, sleep=lambda s: None) == "" and len(calls) == 3


def test_substrings_by_equality(spark):
    from loam.operators.within import holding

    rng = random.Random(12)
    texts = ["".join(rng.choice("ab c\u00e9\U0001f642") for _ in range(rng.randint(0, 12))) for _ in range(40)] + [""]
    terms = sorted({"".join(rng.choice("ab c\u00e9\U0001f642") for _ in range(rng.randint(0, 4))) for _ in range(30)})
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string")
    q = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.k, r.term) for r in holding(t, "text", q, "term").collect()}
    assert got == {(k, y) for k, x in enumerate(texts) for y in terms if y and y in x}
    assert holding(t, "text", q.limit(0), "term").count() == 0


def test_page_holds_the_network_and_a_retrieval(spark):
    from loam.operators import explain

    text = "Alphaone meets Betatwo. Gammathree leaves Alphaone. </script>"
    built = graph.build(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"))
    asked = V.embed(spark.createDataFrame([(1, "Alphaone")], "qid long, query string"), "qid", "query", "q")
    shown = explain.overlay(retrieve.Retrieval(asked, built))
    page = "\n".join(r.line for r in explain.html(built, shown).collect())
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>") and page.count("</script>") == 1
    assert page.count("nodes.push(") == explain.nodes(built).count() and page.count("edges.push(") == explain.edges(built).count()
    assert page.count("path.push(") == shown.count() > 0


@pytest.mark.parametrize("size, overlap", [(1500, 150), (7, 3)])
def test_files_are_chunked_as_one_text(spark, size, overlap):
    rng = random.Random(size)
    texts = {k: "".join(rng.choice("ab\u00e9 \n") for _ in range(n)) for k, n in enumerate([0, 5, 1, 40, 0, 23, 3])}
    texts[7] = None
    rows = [(g, k, t) for g in ("x", "y") for k, t in texts.items() if g == "x" or k != 3] + [("blank", 1, " \n "), (None, 1, "gone")]
    df = spark.createDataFrame(rows, "name string, place long, text string").repartition(4)
    got = {(r.doc_id, r.idx): (r.chunk_id, r.text) for r in extract.chunk_joined(df, "name", "place", workspace(spark, "t"), size, overlap).collect()}
    want = {}
    for g in ("x", "y", "blank"):
        whole = "\n\n".join(t or "" for n, k, t in sorted(rows, key=lambda r: r[1]) if n == g)
        kept = [c for c in (whole[p : p + size].strip() for p in range(0, len(whole), size - overlap)) if c]
        want |= {(g, i): (f"{g}_chunk_{i}", c) for i, c in enumerate(kept)}
    assert got == want


def test_six_files_of_23397_characters_are_18_chunks(spark):
    sizes = [3900, 3900, 3900, 3900, 3900, 23397 - 5 * 3902]
    rows = [("corpus", f"f{k}", "x" * n) for k, n in enumerate(sizes)]
    made = extract.chunk_joined(spark.createDataFrame(rows, "name string, file string, text string"), "name", "file", workspace(spark, "t"))
    assert sorted(r.idx for r in made.select("idx").collect()) == list(range(18))


def test_a_frontier_meets_edges_that_stay_where_they_are(spark):
    rng = random.Random(9)
    rows = [("hub", f"t{k % 3}", f"n{k}", f"e{k}") for k in range(2000)] + [(f"n{rng.randrange(60)}", "t", f"n{rng.randrange(60)}", "e") for _ in range(300)]
    relation = spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "source string, type string, target string, evidence string")
    folder = workspace(spark, "t")
    laid = adjacency.Adjacent.store(relation, folder, buckets=6, hub=100)
    names = spark.createDataFrame([(1, "hub"), (1, "n1"), (2, "n5"), (2, "hub"), (3, "none")], "qid long, name string")
    columns = ["qid", "name", "v", "source", "type", "target", "evidence"]
    plain = graph.Graph(*[None] * 4, relation, *[None] * 4)
    want = sorted(tuple(r) for r in plain.edges_of(names).select(*columns).collect())
    assert sorted(tuple(r) for r in laid.of(names).select(*columns).collect()) == want and len(want) > 4000
    # the hub's edges lie in several files
    assert laid.edges.filter("u = 'hub'").select(F.input_file_name().alias("f")).distinct().count() > 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = laid.of(names)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what lies below each exchange is indented further; no scan of the edges is among it
    lines, below = plan.split("\n"), []
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        below = [d for d in below if d < depth]
        if "Exchange" in line:
            below.append(depth)
        assert not ("FileScan" in line and "evidence" in line and below), plan
    assert "Bucketed: true" in plan
    # another session reads the layout anew
    spark.sql(f"drop table {adjacency._name(folder)}")
    assert sorted(tuple(r) for r in adjacency.Adjacent.load(spark, folder).of(names).select(*columns).collect()) == want


@pytest.mark.parametrize("most", [200_000, 7])
def test_terms_in_texts_are_found_by_reading_each_text_once(spark, monkeypatch, most):
    from loam.operators import within

    monkeypatch.setattr(within, "TERMS", most)
    rng = random.Random(most)
    draw = lambda n: "".join(rng.choice("ab\u00e9\U0001f642 ") for _ in range(n))
    texts = [(k, draw(rng.randrange(40))) for k in range(60)] + [(90, None), (91, ""), (92, draw(1 << 20)), (93, "ab"), (94, "ab")]
    terms = [(k, draw(rng.randrange(6))) for k in range(40)] + [(90, None), (91, "ab"), (92, "ab"), (93, "x" * 300)]
    got = within.holding(spark.createDataFrame(texts, "k long, t string"), "t", spark.createDataFrame(terms, "j long, w string"), "w")
    assert got.columns == ["k", "t", "j", "w"]
    assert sorted((r.k, r.j) for r in got.collect()) == sorted((k, j) for k, t in texts for j, w in terms if t and w and w in t)
    assert within.holding(spark.createDataFrame([], "k long, t string"), "t", spark.createDataFrame([], "j long, w string"), "w").count() == 0


@pytest.mark.parametrize("slice_seconds", [60, 90, 600])
def test_call_rates_by_slices_of_time(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows = [(k, rng.randrange(2), rng.choice([None, *range(-200, 900)])) for k in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.calls, r.over) for r in client.call_rate(df, limit=100, slice_seconds=slice_seconds).collect()}
    for k, u, s in rows:
        n = sum(v == u and (t is None if s is None else t is not None and s - 60 <= t <= s) for _, v, t in rows)
        assert got[k] == (n, n > 100)
    assert len(got) == len(rows)


def test_an_index_finds_most_in_few_cells_and_all_in_as_many_as_it_takes(spark, monkeypatch):
    from loam.operators import index

    monkeypatch.setattr(index, "PART", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16))
    x = centres[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 16)) * 0.35
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 16), (None, x[0].tolist()), (5003, [0.0] * 16)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    made = index.VectorIndex.build(df, "k", "v", workspace(spark, "t"))
    assert made.rows.count() == 3001
    asked = df.filter("k % 100 = 0 or k in (5001, 5002)")
    unit = np.array([v for k, v in rows if k is not None and v and len(v) == 16 and k != 5002])
    ids = np.array([k for k, v in rows if k is not None and v and len(v) == 16 and k != 5002])
    unit = unit / (np.linalg.norm(unit, axis=1, keepdims=True) + 1e-9)
    want = {}
    for q in range(0, 3000, 100):
        score = np.round(unit @ unit[q], 6)
        want[q] = [int(i) for i in ids[np.lexsort((ids, -score))[:10]]]
    get = lambda out: {q: [i for _, i in sorted(own)] for q, own in _by(out).items()}

    def _by(out):
        held = {}
        for r in out.collect():
            held.setdefault(r.qid, []).append((r["rank"], r.id))
        return held

    found = get(made.search(asked, "k", "v", 10, probes=4).filter("qid < 5000"))
    recall = np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want])
    near = made._near(materialize(index._sound(asked, "k", "v", "qid"), workspace(spark, "t"), "a"), 4, False)
    read = made.rows.join(near.select("cell", "qid"), "cell").groupBy("qid").count().agg(F.avg("count")).first()[0]
    assert recall >= 0.9 and read < 3001 / 5
    assert get(made.search(asked, "k", "v", 10, probes=2, exact=True).filter("qid < 5000")) == want
    empty = index.VectorIndex.build(df.limit(0), "k", "v", workspace(spark, "t"))
    assert empty.search(asked, "k", "v", 10, exact=True).count() == 0


def test_nearest_rows_held_and_in_blocks(spark):
    """Both ways of the nearest rows against plain loops: ties, two widths, missing vectors and unsound ones."""
    import numpy as np

    from loam.operators import similar
    from loam.operators.retrieve import best

    rng = np.random.default_rng(0)
    some = lambda n, wide: [float(v) for v in rng.integers(-3, 4, wide)] if n else None
    rows = [(f"c{i}", some(i % 97, 6 if i % 5 else 4)) for i in range(300)]
    rows[3], rows[4] = ("c3", [float("nan")] * 6), ("c4", [1.0, None, 2.0, 3.0, 4.0, 5.0])
    asked = [(i, some(i % 20, 6 if i % 7 else 4)) for i in range(60)]
    r, q = spark.createDataFrame(rows, "chunk_id string, embedding array<double>"), spark.createDataFrame(asked, "qid long, q array<double>")
    for missing, k in ((None, 3), (0.0, 3), (0.0, 400)):
        want = set()
        for i, v in asked:
            score = []
            for c, x in rows:
                if v and x and len(v) == len(x) and all(e is not None and e == e for e in x):
                    score.append((-round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x) + 1e-9)), 6) + 0.0, c))
                elif missing is not None:
                    score.append((-missing + 0.0, c))
            want |= {(i, c) for _, c in sorted(score)[:k]}
        for few, block in ((4096, 4096), (10, 50), (10, 5000)):
            got = best(similar.nearest(r, q, "chunk_id", k, missing, few, block), "similarity", "chunk_id", k)
            assert {(x.qid, x.chunk_id) for x in got.collect()} == want, (missing, k, few, block)
    assert similar.nearest(r.limit(0), q, "chunk_id", 3, few=0).count() == 0 == similar.nearest(r, q.limit(0), "chunk_id", 3, few=0).count()


def test_members_of_communities_in_pages(spark, tmp_path):
    from loam.operators import community

    labels = spark.createDataFrame([(f"t{k}", "t0") for k in range(9)] + [("u", "u"), ("x", "x")], "concept string, root string")
    members = spark.createDataFrame([(f"t{k}", f"e{j:02}") for k in range(9) for j in range(k, k + 5)] + [("u", "e99")], "concept string, entity string")
    pages = community.member_pages(labels, members, str(tmp_path), 4)
    got = sorted((r.root, r.place, r.page, r.entity) for r in pages.collect())
    assert got == [("t0", k, k // 4, f"e{k:02}") for k in range(13)] + [("u", 0, 0, "e99")]
    rows = {r.root: (r.n_concepts, r.n_members, r.members) for r in community.summarise(labels, pages, str(tmp_path)).collect()}
    assert rows == {"t0": (9, 13, ["e00", "e01", "e02", "e03"]), "u": (1, 1, ["e99"]), "x": (1, 0, [])}


def test_common_names_bring_the_first_places_only(spark):
    """A question's chunks and claims are the first of all its names', though each name hands on no more than that many."""
    rng = random.Random(4)
    names = ["Aaa", "Bbb", "Ccc", "Ddd"]
    claims = [(d, i, p, rng.choice(names), rng.choice(names), "x") for d in range(12) for i in range(3) for p in range(8)]
    claims += rng.sample(claims, 60)  # some come again
    matched = [(1, "aaa", "Aaa"), (1, "bbb", "Bbb"), (2, "ccc", "Ccc"), (3, "zzz", "Zzz")]
    vector = [(1, f"{d}_chunk_{i}", d * 3 + i + 1) for d in range(2) for i in range(3)] + [(2, "9_chunk_0", 1)]
    rows = spark.createDataFrame(claims, "doc_id long, idx int, pos int, source string, target string, type string")
    asked = spark.createDataFrame(matched, "qid long, key string, name string")
    found = flat.matched_relationships(asked, rows)
    got = sorted((r.qid, r.place, r.source, r.target) for r in found.collect())
    want = []
    for qid in (1, 2):
        own = {n for q, _, n in matched if q == qid}
        first = sorted({c for c in claims if own & {c[3], c[4]}})[:10]
        want += [(qid, k + 1, c[3], c[4]) for k, c in enumerate(first)]
    assert got == want
    postings = rows.select(F.lower("source").alias("key"), "doc_id", "idx")
    near = spark.createDataFrame(vector, "qid long, chunk_id string, rank int")
    context = flat.merged_context(near, asked, postings)
    got = sorted((r.qid, r.place, r.chunk_id) for r in context.collect())
    want = []
    for qid in (1, 2):
        first = [c for q, c, _ in vector if q == qid]
        own = {k for q, k, _ in matched if q == qid}
        more = [f"{d}_chunk_{i}" for d, i in sorted({c[:2] for c in claims if c[3].lower() in own}) if f"{d}_chunk_{i}" not in first]
        want += [(qid, k + 1, c) for k, c in enumerate((first + more)[:10])]
    assert got == want
    # what is not among the first places is left before questions are joined
    for made in (found, context):
        assert "dense_rank" in made._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_a_hub_are_bounded_and_its_communities_right(spark, tmp_path):
    # a node of more neighbours than one list holds, in a clique beside another
    n = leiden.LIST + 6
    near = spark.range(1, n).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("u"), F.lit(1.0).alias("w"))
    sizes = [r[0] for r in leiden._listed(near).select(F.size("edges")).collect()]
    assert sum(sizes) == n - 1 and max(sizes) <= leiden.LIST
    star = [("m", f"x{k:05d}", 1.0) for k in range(n)] + [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("c", "m", 0.5)]
    edges = spark.createDataFrame(star, "a string, b string, w double")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = {r.id: r.root for r in leiden.leiden(ids, edges, f"file://{tmp_path}", few=0).collect()}
    assert len(found) == n + 4 and {found[x] for x in "abc"} == {"a"} and {found[x] for x in found if x not in "abc"} == {"m"}


def test_neighbourhood_deals_hops_by_their_edges(spark, tmp_path):
    # every seed meets in one hub of many edges: shares of its steps go to several tasks
    edges = [(f"s{k}", "hub", "x") for k in range(20)] + [("hub", f"t{k}", "x") for k in range(50)]
    relation = spark.createDataFrame(edges, "source string, target string, type string")
    seeds = spark.createDataFrame([(f"s{k}",) for k in range(20)], "seed string")
    rows = graph.neighbourhood(relation, seeds, 2, f"file://{tmp_path}", steps=100)
    want = {(f"s{k}", f"s{k}", 0) for k in range(20)} | {(f"s{k}", "hub", 1) for k in range(20)}
    want |= {(f"s{k}", x, 2) for k in range(20) for x in [f"s{i}" for i in range(20) if i != k] + [f"t{i}" for i in range(50)]}
    assert {tuple(r) for r in rows.collect()} == want
    both, degree = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("both", "degree"))
    step, parts = graph._stepped(seeds.select("seed", F.lit("hub").alias("node")), both, degree, 100)
    assert parts == 14 and step.count() == 1400 and max(step.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 700


def test_small_components_of_a_large_graph_need_no_rounds(spark, monkeypatch):
    chains = [(f"c{n}.{k}", f"c{n}.{k + 1}") for n in range(6) for k in range(1, 5)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in chains], "a string, b string, weight int")
    names = edges.select(F.explode(F.array("a", "b")).alias("concept")).unionByName(spark.createDataFrame([("lone",)], "concept string")).distinct()
    rows = lambda few: {tuple(r) for r in community.detect(names, edges, workspace(spark, "t"), few=few).collect()}
    one = rows(1000)

    def broken(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(leiden, "_numbers", broken)
    assert rows(5) == one and ("lone", "lone") in one and len(one) == 31


def test_name_vectors_are_merged_at_every_size(spark):
    rows = [(f"k{i}", f"Name{i}", "A", "", i, 0, (i, 0, 0), 1) for i in range(4)]
    entities = spark.createDataFrame(rows, "canon string, name string, type string, description string, doc_id long, idx long, first_place struct<doc_id:long,idx:long,pos:long>, n_mentions long")
    whole = resolve.merge_similar(entities, lambda df: df.withColumn("name_vector", F.array(F.col("n") + 1.0, F.lit(1.0))), workspace(spark, "t"), 0.95)
    plan = [line for line in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "name_vector" in line]
    assert plan and all("SortMergeJoin" in line for line in plan) and whole.count() < 4
