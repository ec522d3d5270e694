"""Communities by modularity for graphs of any size: parallel Leiden as rounds of joins.

Each level moves nodes between communities, refines every community into parts that hang together, and
contracts each part to a node of the next level. A round is a few joins and aggregations over edges, ended
by a written table; no task holds a component or a community, and hubs are read from written tables, which
adaptive execution may split. Nodes go by their numbers in the order of their names, so the smaller number is the smaller
name, and the edges of a level are written as short lists under the node whose community the round looks up.

What moves at once must not undo itself: in each round a hash of (community, round) makes half of the
communities givers and half takers, and only givers' nodes move, each to the taker with the largest gain
(equal gains: the smaller name). Refinement starts from single nodes and moves only what is still single
to a neighbouring part of its own community, so parts are connected. At the end communities are cut into
their connected parts, which never lowers modularity.

A level of ``few`` edges at most, a graph that any task can hold, is finished in one by joining, again and again, the two
communities that gain most; ``few=0`` goes by rounds to the end. So is every connected component of so few edges in a larger graph, many of
them to a task: no gain crosses components, so they come out as they would in one task, and rounds are left to components that are larger.
"""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.store import materialize, numbered

#: Levels at most; rounds of a level, and of one whose nodes are communities already; rounds of refinement; the rounds
#: of single nodes at first end when no more than this share of them would still move, all others when none would.
LEVELS, ROUNDS, SETTLING, REFINEMENTS, STILL = 20, 6, 10, 3, 0.002

#: Rounds of single nodes at the end, at most: they go on until none would move, as a node that stays in the wrong community
#: may also name it. Communities are large by then, so nodes move by themselves, seven of eight that would in each of the first
#: rounds and half in the others.
LAST, BOLD = 60, 3


#: Edges that one task may be given.
FEW = 50_000

#: Neighbours in one list; a node with more has several.
LIST = 1024

#: Edges from which on a graph is grown together first, rounds of that, and rows that may go to every task.
GROWN, GROWTH, HELD = 500_000, 8, 100_000


def joined(degree: dict[str, float], edges: list[tuple[str, str, float]], double: float) -> dict[str, str]:
    """The community of each node: the pair with the best gain is joined until none gains, ties by the smaller names.
    Communities have the name of their smallest node. A join changes the gains of the joined community alone, so the
    others stay in a heap. ``double``: twice the weight of the whole graph."""
    degree = dict(degree)
    between: dict[str, dict[str, float]] = {v: {} for v in degree}
    for a, b, w in edges:
        between[a][b] = between[b][a] = w
    age, into = dict.fromkeys(degree, 0), {}

    def gain(a: str, b: str) -> tuple[float, str, str, int, int]:
        a, b = min(a, b), max(a, b)
        return (-round((between[a][b] - degree[a] * degree[b] / double) / double, 14), a, b, age[a], age[b])

    heap = [gain(a, b) for a in between for b in between[a] if a < b]
    heapify(heap)
    while heap:
        least, a, b, was_a, was_b = heappop(heap)
        if least >= 0:
            break
        if a in into or b in into or (was_a, was_b) != (age[a], age[b]):
            continue
        into[b] = a
        for c, w in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0) + w
        degree[a] += degree.pop(b)
        age[a] += 1
        for c in between[a]:
            heappush(heap, gain(a, c))
    out = {}
    for v in between | into:
        root = v
        while root in into:
            root = into[root]
        out[v] = root
    return out


def _finished(state: DataFrame, near: DataFrame, double: float) -> DataFrame:
    """(id, c): the communities of a small level, found in one task."""
    edges = near.filter("v < u").join(state.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v").join(state.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        degree = dict(zip(part.v, part.kv, strict=True)) | dict(zip(part.u, part.ku, strict=True))
        found = joined(degree, sorted(zip(part.v, part.u, part.w, strict=True)), double)
        return pd.DataFrame({"id": list(found), "c": list(found.values())})

    return edges.groupBy(F.lit("all")).applyInPandas(work, "id long, c long")


def _bit(name: str, salt: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(name), salt), F.lit(2))


def both_ways(edges: DataFrame) -> DataFrame:
    """(v, u, w): every edge (a, b, w) from both ends."""
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "w").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "w"))


def _listed(near: DataFrame) -> DataFrame:
    """(u, edges): the edges (v, u, w) under u, in lists of (v, w)."""
    place = F.row_number().over(Window.partitionBy("u").orderBy("v"))
    return near.withColumn("part", F.floor((place - 1) / LIST)).groupBy("u", "part").agg(F.collect_list(F.struct("v", "w")).alias("edges")).drop("part")


def _sided(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` in number, for a join: to every task if few, else merged. Their bytes in files say little of their number."""
    return rows.hint("broadcast" if n <= HELD else "merge")


def grown(ids: DataFrame, near: DataFrame, share: int, folder: str, name: str = "grown", most: float | None = None) -> DataFrame:
    """(id, c): connected parts that grow from every ``share``-th of ``ids`` along edges (v, u, w), each node joining the part that
    most weight leads to (equal weights: by a hash). What no part reaches stays alone. Only nodes that joined in the round before
    hand their part on, so all rounds see each edge about once.
    ``most``: parts stop growing, and nodes (id, k) stay alone, from that degree on."""
    spark, n = ids.sparkSession, ids.count()
    able = ids if most is None else ids.filter(F.col("k") <= most)
    part = able.filter(F.pmod(F.xxhash64("id", F.lit(name)), F.lit(share)) == 0).select("id", F.col("id").alias("c"))
    part = materialize(part, folder, f"{name}-0")
    known, paths, labelled = part, [f"{folder}/{name}-0"], 0
    for k in range(1, GROWTH + 1):
        new = part.count()
        labelled += new
        if not new or n - labelled <= n // 100:
            break
        if most is not None:
            full = known.join(ids.hint("merge"), "id").groupBy("c").agg(F.sum("k").alias("total")).filter(F.col("total") > most)
            part = part.join(full.select("c"), "c", "left_anti")
        met = near.join(_sided(part.select(F.col("id").alias("u"), "c"), new), "u").groupBy("v", "c").agg(F.sum("w").alias("w"))
        met = met.join(known.select(F.col("id").alias("v")).hint("merge"), "v", "left_anti")
        if most is not None:
            met = met.join(able.select(F.col("id").alias("v")).hint("merge"), "v", "left_semi")
        best = F.max(F.struct("w", F.xxhash64("c", "v").alias("h"), "c")).alias("best")
        part = materialize(met.groupBy("v").agg(best).select(F.col("v").alias("id"), F.col("best.c").alias("c")), folder, f"{name}-{k}")
        paths.append(f"{folder}/{name}-{k}")
        known = spark.read.schema(part.schema).parquet(*paths)
    return materialize(ids.select("id").join(known.hint("merge"), "id", "left").select("id", F.coalesce("c", "id").alias("c")), folder, f"{name}-all")


def _contracted(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (a, b, w) between parts (id, c), those inside of one left out."""
    end = lambda x: parts.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")).hint("merge")
    rows = edges.join(end("a"), "a").join(end("b"), "b").filter("c_a <> c_b")
    return rows.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("w").alias("w"))


def _state(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, k, c, outer, moved, wants, total): nodes with the summed degree of their community."""
    nodes = materialize(nodes, folder, f"{name}-nodes")  # read twice, and a round over the edges lies behind it
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    return materialize(nodes.join(totals, "c").select("id", "k", "c", "outer", "moved", "wants", "total"), folder, name)


def _round(state: DataFrame, n: int, listed: DataFrame, double: float, salt: Column, single: bool) -> DataFrame:
    """``state`` without totals after one round: which nodes want to move, and where those are that could.
    ``single``: only communities of one node give, and only to communities inside the same ``outer`` one."""
    seen = listed.join(_sided(state.select(F.col("id").alias("u"), F.col("c").alias("to"), F.col("outer").alias("their"), "total"), n), "u")
    # dealt by v once: the sums, their join and the choice are all made where a node's edges are
    seen = seen.select("to", "their", "total", F.inline("edges")).repartition("v")
    sums = seen.groupBy("v", "to").agg(F.sum("w").alias("w"), F.first("total").alias("total"), F.first("their").alias("their"))
    own = state.select(F.col("id").alias("v"), "k", "c", "outer", F.col("total").alias("own_total"))
    rows = sums.join(_sided(own, n), "v")
    home = F.col("to") == F.col("c")
    score = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(home, F.col("k")).otherwise(0.0)) / double, 9)
    may = ~home
    if single:
        may &= (F.col("own_total") == F.col("k")) & (F.col("outer") == F.col("their"))
    turn = may & (_bit("c", salt) == 0) & (_bit("to", salt) == 1)
    best = rows.groupBy("v").agg(F.min(F.when(turn, F.struct((-score).alias("less"), "to"))).alias("best"), F.max(F.when(may, score)).alias("hope"), F.max(F.when(home, score)).alias("stay"))
    joined = state.join(best, state.id == best.v, "left")
    stay = F.coalesce(best.stay, F.round(-F.col("k") * (F.col("total") - F.col("k")) / double, 9)) + 1e-9
    moves = F.coalesce(-F.col("best.less") > stay, F.lit(False))
    wants = F.coalesce(F.col("hope") > stay, F.lit(False))
    return joined.select("id", "k", F.when(moves, F.col("best.to")).otherwise(F.col("c")).alias("c"), "outer", moves.alias("moved"), wants.alias("wants"))


def _last(nodes: DataFrame, kept: DataFrame, near: DataFrame, double: float, folder: str) -> DataFrame:
    """(id, c) after rounds of moves of single nodes (id, k, c), ``LAST`` at most, until none would move. What a round needs are
    the edges between communities: the weight of a node inside its own is the rest of its degree. After a round only the edges of nodes
    that moved are looked up, among ``kept`` (a, b, w) from both ends (``near``: v, u, w)."""
    state = materialize(nodes.select("id", "k", "c", F.lit(False).alias("moved")), folder, "last")
    own = lambda x, y: state.select(F.col("id").alias(x), F.col("k").alias(f"k{y}"), F.col("c").alias(f"c{y}"), F.col("moved").alias(f"m{y}")).hint("merge")
    cross = kept.join(own("a", "v"), "a").join(own("b", "u"), "b").filter("cv <> cu").withColumnsRenamed({"a": "v", "b": "u"})
    columns = ["v", "kv", "cv", "u", "ku", "cu", "w"]
    turned = [F.col(c).alias(d) for c, d in zip(["u", "ku", "cu", "v", "kv", "cv", "w"], columns, strict=True)]
    cross = materialize(cross.select(*columns).unionByName(cross.select(*turned)), folder, "cross")
    for k in range(LAST):
        totals = materialize(state.groupBy("c").agg(F.sum("k").alias("total")), folder, f"last-totals-{k}")
        many = totals.count()
        total = lambda c, name: _sided(totals.select(F.col("c").alias(c), F.col("total").alias(name)), many)  # noqa: E731, B023
        sums = cross.groupBy("v", "kv", "cv", "cu").agg(F.sum("w").alias("w")).join(total("cu", "their"), "cu").join(total("cv", "own"), "cv")
        score = F.round(F.col("w") - F.col("kv") * F.col("their") / double, 9)
        best = sums.groupBy("v", "kv", "cv", "own").agg(F.min(F.struct((-score).alias("less"), F.col("cu").alias("to"))).alias("best"), F.sum("w").alias("out"))
        stay = F.round(F.col("kv") - F.col("out") - F.col("kv") * (F.col("own") - F.col("kv")) / double, 9) + 1e-9
        turn = F.pmod(F.xxhash64("v", F.lit(k)), F.lit(8)) < (7 if k < BOLD else 4)
        wants = materialize(best.filter(-F.col("best.less") > stay).select(F.col("v").alias("id"), F.col("best.to").alias("to"), turn.alias("turn")), folder, f"wants-{k}")
        n, moving = wants.agg(F.count(F.lit(1)), F.count_if("turn")).first()
        if not n:
            break
        if not moving:
            continue
        movers = wants.filter("turn").select("id", "to")
        state = materialize(state.join(_sided(movers, moving), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), folder, f"last-{k}")
        gone = lambda x: _sided(movers.select(F.col("id").alias(x)), moving)  # noqa: E731, B023
        new = near.join(gone("v"), "v", "left_semi").join(own("v", "v"), "v").join(own("u", "u"), "u").filter("cv <> cu")
        new = materialize(new.select(*columns, "mu"), folder, f"new-{k}")
        # an edge between two that moved comes from both ends already
        back = new.filter("not mu").select(*turned)
        cross = cross.join(gone("v"), "v", "left_anti").join(gone("u"), "u", "left_anti").unionByName(new.select(*columns)).unionByName(back)
        cross = materialize(cross, folder, f"cross-{k}")
    return state.select("id", "c")


def _moved(state: DataFrame, listed: DataFrame, double: float, folder: str, name: str, rounds: int, still: float, single: bool = False) -> tuple[DataFrame, bool]:
    """``state`` after rounds of moves, until no more than the share ``still`` wants to move, and whether that is so and nothing moved."""
    salt, settled, n = F.crc32(F.lit(name.encode())), True, state.count()
    for k in range(rounds):
        state = _state(_round(state, n, listed, double, salt + k, single), folder, f"{name}-{k}")
        n, moved, wants = state.agg(F.count(F.lit(1)), F.count_if("moved"), F.count_if("wants")).first()
        settled &= moved == 0 and wants == 0
        if wants <= still * n:
            break
    return state, settled


def reach(ids: DataFrame, edges: DataFrame, folder: str, name: str = "parts") -> DataFrame:
    """(id, root): the smallest id within reach over edges (a, b). Labels run along edges and jump to their
    root's; what many rows hang on is written before it is joined, so that adaptive execution may split them."""
    near = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), folder, f"{name}-near")
    state = materialize(ids.select("id", F.col("id").alias("root")).distinct().withColumn("changed", F.lit(True)), folder, f"{name}-0")
    n = state.count()
    for k in range(1, 1000):
        least = near.join(_sided(state.select(F.col("id").alias("b"), "root"), n), "b").groupBy("a").agg(F.min("root").alias("least"))
        step = state.join(least, F.col("id") == F.col("a"), "left").select("id", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        step = materialize(step, folder, f"{name}-{k}-step")
        far = step.select(F.col("id").alias("r"), F.col("root").alias("far"))
        state = step.join(_sided(far, n), F.col("root") == F.col("r")).select("id", F.least("root", "far").alias("root"), (F.least("root", "far") < F.col("old")).alias("changed"))
        state = materialize(state, folder, f"{name}-{k}")
        if state.filter("changed").isEmpty():
            return state.select("id", "root")
    raise RuntimeError("no fixed point")


def connected(labels: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """(id, root): the connected parts of the communities (id, c), named by their smallest member."""
    end = lambda x: labels.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")).hint("merge")
    inside = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b").filter("ca = cb").select("a", "b")
    inside = materialize(inside, folder, "inside-labels")
    if inside.count() <= GROWN:
        return reach(labels, inside, folder)
    # what has grown together is one node each, and few are left
    inside = inside.withColumn("w", F.lit(1.0))
    near = materialize(both_ways(inside), folder, "inside-near")
    parts = grown(labels.select("id").distinct(), near, max(2, math.isqrt(labels.count()) // 4), folder, "inside-grown")
    links = materialize(_contracted(inside, parts), folder, "inside-links")
    whole = reach(parts.select(F.col("c").alias("id")), links, folder)
    members = materialize(parts.join(whole.withColumnRenamed("id", "c").hint("merge"), "c").select("id", "root"), folder, "inside-members")
    names = members.groupBy("root").agg(F.min("id").alias("name"))
    return members.join(names, "root").select("id", F.col("name").alias("root"))


def leiden(nodes: DataFrame, edges: DataFrame, folder: str, few: int = FEW) -> DataFrame:
    """(id, root) of nodes (id) under undirected edges (a, b, w): communities named by their smallest member.

    Repeated edges add up, edges of a node to itself and those of weight 0 or less count for nothing; nodes
    without an edge are communities of their own.
    """
    kept = edges.filter("a <> b and w > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w"))
    names = materialize(numbered(nodes.select("id").distinct(), ["id"], folder, "names"), folder, "numbers")
    end = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}")).hint("merge")
    kept = kept.groupBy("a", "b").agg(F.sum("w").alias("w")).join(end("a"), "a").join(end("b"), "b")
    kept = materialize(kept.select(F.col("n_a").alias("a"), F.col("n_b").alias("b"), "w"), folder, "edges")
    double = 2 * (kept.agg(F.sum("w")).first()[0] or 0.0)
    if not double:
        return names.select("id", F.col("id").alias("root"))
    found = _split(names.select(F.col("n").alias("id")), kept, double, folder, few)
    root = names.select(F.col("id").alias("name"), F.col("n").alias("root"))
    return found.join(root.hint("merge"), "root").join(names.withColumnRenamed("id", "own").hint("merge"), F.col("id") == F.col("n")).select(F.col("own").alias("id"), F.col("name").alias("root"))


def _split(alone: DataFrame, kept: DataFrame, double: float, folder: str, few: int) -> DataFrame:
    """(id, root) of ``_numbers``, with components of ``few`` edges at most finished apart from larger ones."""
    if not few or kept.count() <= few:
        return _numbers(alone, kept, double, folder, few)
    part = reach(alone, kept, folder, "components").withColumnRenamed("root", "part")
    inside = materialize(kept.join(part.select(F.col("id").alias("a"), "part"), "a"), folder, "inside")
    counted = materialize(inside.groupBy("part").agg(F.count(F.lit(1)).alias("edges")), folder, "sizes")
    small = counted.filter(F.col("edges") <= few)
    total = small.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // few))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(rows.a, rows.b, rows.w, strict=True))
        degree: dict[int, float] = {}
        for a, b, w in edges:
            degree[a], degree[b] = degree.get(a, 0.0) + w, degree.get(b, 0.0) + w
        found = joined(degree, sorted(edges), double)
        return pd.DataFrame({"id": list(found), "root": list(found.values())}, dtype="int64")

    own = inside.join(small.select("part"), "part").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks)))
    found = own.groupBy("task").applyInPandas(work, "id long, root long")
    large = counted.filter(F.col("edges") > few).select("part")
    if not large.isEmpty():
        rest = materialize(inside.join(large, "part").select("a", "b", "w"), folder, "large")
        ids = materialize(part.join(large, "part").select("id"), folder, "large-ids")
        found = found.unionByName(_numbers(ids, rest, double, f"{folder}/rounds", few))
    found = materialize(found, folder, "found")
    return alone.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _numbers(alone: DataFrame, kept: DataFrame, double: float, folder: str, few: int) -> DataFrame:
    """(id, root) of ``leiden`` for numbered nodes (id) and edges (a, b, w), once each. ``double``: twice the weight of the whole graph."""
    level = both_ways(kept)
    place = materialize(alone.select("id", F.col("id").alias("node")), folder, "place")
    degrees = level.groupBy("v").agg(F.sum("w").alias("k")).select(F.col("v").alias("id"), "k")
    fresh = {"outer": F.lit(None).cast("long"), "moved": F.lit(False), "wants": F.lit(True)}
    state = degrees.select("id", "k", F.col("id").alias("c"), F.col("k").alias("total")).withColumns(fresh)
    state = materialize(state, folder, "level-0")
    near = near_0 = materialize(level, folder, "near-0")
    finished, begin = False, 0
    nodes, links = state.count(), kept.count()
    share = int(nodes / math.sqrt(double))
    if links > max(few, GROWN) and share > 1:
        # parts of a degree of sqrt(double) and less: any two of them with an edge of weight 1 gain by joining, so none is too large yet
        parts = grown(state.select("id", "k"), near, share, folder, most=4 * math.sqrt(double))
        place = materialize(place.join(parts.withColumnRenamed("id", "node").hint("merge"), "node", "left").select("id", F.coalesce("c", "node").alias("node")), folder, "place-grown")
        near = materialize(both_ways(materialize(_contracted(kept, parts), folder, "grown-edges")), folder, "near-grown")
        merged = state.select("id", "k").join(parts.hint("merge"), "id").groupBy("c").agg(F.sum("k").alias("k"))
        state = materialize(merged.select(F.col("c").alias("id"), "k", "c", F.col("k").alias("total")).withColumns(fresh), folder, "level-grown")
        begin = 1
    for depth in range(begin, LEVELS):
        finished = near.count() <= 2 * few
        if finished:
            level_labels = materialize(_finished(state, near, double), folder, "joined")
            state = state.select("id").join(level_labels, "id", "left").select("id", F.coalesce("c", "id").alias("c"))
            break
        listed = materialize(_listed(near), folder, f"listed-{depth}")
        state, settled = _moved(state, listed, double, folder, f"move-{depth}", *((SETTLING, 0.0) if depth else (ROUNDS, STILL)))
        if depth and settled and state.agg(F.count(F.lit(1)) == F.count_distinct("c")).first()[0]:
            break
        if depth and settled:  # no part gains by itself; whole communities may, as the nodes of the next level
            parts = state.select("id", "k", "c", F.col("c").alias("outer"))
        else:
            single = state.select("id", "k", F.col("id").alias("c"), F.col("c").alias("outer"), F.lit(False).alias("moved"), F.lit(True).alias("wants"), F.col("k").alias("total"))
            parts, _ = _moved(single, listed, double, folder, f"refine-{depth}", REFINEMENTS, STILL, True)
        n = parts.count()
        place = materialize(place.join(_sided(parts.select(F.col("id").alias("node"), "c"), n), "node", "left").select("id", F.coalesce("c", "node").alias("node")), folder, f"place-{depth}")
        own, other = parts.select(F.col("id").alias("v"), F.col("c").alias("cv")), parts.select(F.col("id").alias("u"), F.col("c").alias("cu"))
        # edges inside a part only count in its degree
        near = near.join(_sided(own, n), "v").join(_sided(other, n), "u").filter("cv <> cu").groupBy(F.col("cv").alias("v"), F.col("cu").alias("u")).agg(F.sum("w").alias("w"))
        near = materialize(near, folder, f"near-{depth + 1}")
        # a part keeps the community that it was refined from
        merged = parts.groupBy("c").agg(F.sum("k").alias("k"), F.min("outer").alias("outer")).select(F.col("c").alias("id"), "k", F.col("outer").alias("c"))
        state = _state(merged.withColumns(fresh), folder, f"level-{depth + 1}")
    # single nodes once more, from the communities at hand, until none would move
    labels = place.join(_sided(state.select(F.col("id").alias("node"), "c"), state.count()), "node", "left").select("id", F.coalesce("c", "node").alias("c"))
    labels = materialize(labels, folder, "labels")
    if finished and not depth:  # joined along edges from single nodes on: connected, and named by the smallest
        return labels.withColumnRenamed("c", "root")
    last = _last(degrees.join(labels.hint("merge"), "id"), kept, near_0, double, folder)
    labels = labels.select("id").join(last.select("id", "c").hint("merge"), "id", "left").select("id", F.coalesce("c", "id").alias("c"))
    return connected(materialize(labels, folder, "settled"), kept, folder)
