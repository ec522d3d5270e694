"""Groups of alike rows without all-pairs joins: blocked buckets, connected components.

``blocks`` and ``deal`` put the rows of each key into blocks of bounded weight and send every pair
of blocks to one task, so a hot key spreads over many tasks, each of bounded memory, and no pair of rows
of one key is missed or emitted. ``scan`` feeds a function with one block pair at a time.
``components`` alternates large-star and small-star steps on edges (Kiveris et al., 2014),
cutting lineage with a written table after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.store import materialize


#: Blocks of a key of middling weight at most, and by how much they are smaller than the limit.
SPREAD = 64
SMALLER = 8


def blocks(df: DataFrame, keys: list[str], weight, limit: int, folder: str, name: str, least: int = 1, smaller: int = SMALLER) -> DataFrame:
    """(keys, n_blocks): in how many blocks each key's weight goes, none over ``limit``; keys of
    middling weight go in up to ``SPREAD`` smaller ones, so that many tasks share them. Keys of
    fewer than ``least`` rows are left out.

    It is written, so that two plain tables meet where rows are joined with it on the key:
    adaptive execution may then split a hot key's rows among tasks, which it may not beside an
    aggregate."""
    n_blocks = F.greatest(F.lit(1), F.ceil(F.sum(weight) / limit), F.least(F.lit(SPREAD), F.ceil(F.sum(weight) / max(1, limit // smaller))))
    totals = df.groupBy(*keys).agg(n_blocks.cast("int").alias("n_blocks"), F.count(F.lit(1)).alias("deal_rows"))
    return materialize(totals.filter(F.col("deal_rows") >= least).drop("deal_rows"), folder, f"blocks-{name}")


def deal(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Rows (with ``n_blocks`` of their key) with own block ``blk`` and block pair (``bi``, ``bj``),
    several times where a key has several blocks; sorted by key and pair inside partitions."""
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(unit), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumns({"bi": F.least("blk", "other"), "bj": F.greatest("blk", "other")}).drop("other")
    return rows.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")


def scan(df: DataFrame, keys: list[str], schema: T.StructType, work: Callable[[pa.Table], pa.RecordBatch | None], most_rows: int = 4096) -> DataFrame:
    """Apply ``work`` to tables of whole (key, bi, bj) groups of a frame that ``deal`` sorted."""
    columns = [*keys, "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = work(pa.Table.from_batches(held))
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                own = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                change[1:] |= own[1:] != own[:-1]
                if held:
                    before = held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py()
                    change[0] |= own[0] != before
            borders = np.flatnonzero(change)
            # whole groups are cut off only when enough rows are together
            start = 0
            if len(borders) and rows + int(borders[-1]) >= most_rows or (len(borders) and held and rows >= most_rows):
                cut = int(borders[-1])
                if cut:
                    held.append(batch.slice(0, cut))
                yield from flush()
                held, rows, start = [], 0, cut
            held.append(batch.slice(start))
            rows += batch.num_rows - start
        yield from flush()

    return df.mapInArrow(run, schema)


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows of the given columns, and the number of rows."""
    n = len(columns[0])
    change = np.ones(n, bool)
    change[1:] = False
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def spanning(n: int, compare: Callable[[int, np.ndarray], np.ndarray], allowed: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links among ``n`` rows connect.

    ``compare(i, js)`` tells which of the later rows ``js`` row ``i`` links to. Rows that are
    connected already are not compared again, so a tight group costs n comparisons.
    """
    label = np.arange(n)
    edges = []
    for i in range(n - 1):
        later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if allowed is not None and len(later):
            later = later[allowed(i, later)]
        if not len(later):
            continue
        for j in later[compare(i, later)].tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def least_reached(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For every row the smallest id within reach of its links."""
    root = ids.copy()
    unseen = np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable").tolist():
        if not unseen[i]:
            continue
        unseen[i] = False
        reached = [i]
        for j in reached:  # grows while it is read
            new = np.flatnonzero(linked[j] & unseen)
            unseen[new] = False
            root[new] = ids[i]
            reached += new.tolist()
    return root


def first_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For every row of ``n`` the first row within reach over the pairs (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root] != root).any():  # every row hangs on its root again
            root[up] = root[root[up]]


def _stars(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """One large-star and one small-star step on distinct edges (hi, lo) with hi > lo.

    What nodes hang on is written before it is joined: adaptive execution can then split the
    edges of a hub among tasks, which it cannot beside an aggregate."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), folder, f"{name}-least")
    large = materialize(edges.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct(), folder, f"{name}-large")
    lowest = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), folder, f"{name}-lowest")
    pairs = large.join(lowest, F.col("hi") == F.col("u")).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return pairs.select("e.hi", "e.lo").filter("hi > lo").distinct()


def components(edges: DataFrame, folder: str, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every end of the edges (a, b): the smallest id it can reach. Rounds grow
    with the logarithm of the longest path; not to have settled after ``most_rounds`` raises."""
    current = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    current = materialize(current, folder, f"{name}-0")
    for step in range(1, most_rounds + 1):
        current = materialize(_stars(current, folder, f"{name}-{step}"), folder, f"{name}-{step}")
        # done when every node hangs on one root and no root hangs on another
        roots = current.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        chained = current.join(roots.select(F.col("hi").alias("r")), F.col("lo") == F.col("r"), "left_semi").limit(1)
        if roots.filter("n > 1").select("hi").limit(1).unionByName(chained.select("hi")).isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
