"""Hard negatives: rows of another label that score almost as high as an anchor's positives.

Scores are inner products of whole numbers, made by blocked dense matrix products in float64. A
block's products are exact while ``|anchor| * |row|`` stays below 2^53; larger ones are multiplied as
64-bit integers. Candidates are dealt into blocks of bounded bytes, each of which a task holds once;
anchors are sent to every block and pass through it a bounded batch at a time, so a task holds
one block and one batch, whatever the number of either. Two passes: the first keeps each anchor's
best ``positives`` rows of its label in every block, which merge into the best of all blocks; the
second holds each anchor's windows (``low`` to ``high`` per cent of each positive's score) against every
block and keeps the best ``negatives`` of each, merged likewise. No pair that fails becomes a row.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component take
no part, nor do those whose squares sum to 2^62 or more (their scores need not fit a long); vectors of
different length have no score; rows with the anchor's id are not "other" rows; an id that occurs
several times stands for as many rows, each anchor of them with its own result; a positive with a negative
score has an empty window; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm import textkit
from loam.llm.store import materialize, workspace

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
#: Bytes of components in a block of candidates, and no fewer rows than this in one unless the table has fewer.
BLOCK_BYTES, LEAST_ROWS = 16 << 20, 1024
#: Products made at once in a task.
PRODUCTS = 1 << 21
#: Products below this are exact in float64.
EXACT = float(1 << 53)
MOST_SQUARES = float(1 << 62)


def sound(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part, with the components floored at ``scale`` times."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("double"))
    finite = ~F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.abs(x) > 1e15))
    plain = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(finite & (F.size(vector) > 0))
    out = plain.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), whole.alias("v")).filter("label is not null")
    return out.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < MOST_SQUARES)


def _meet(candidates: DataFrame, anchors: DataFrame, blocks: int, extra: list[tuple[str, str]]) -> DataFrame:
    """Rows of every block (``anchor`` null), followed by all anchors, in the same partition."""
    own = candidates.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), F.lit(None).cast("long").alias("anchor"), "id", "label", "v", *[F.lit(None).cast(kind).alias(c) for c, kind in extra])
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), "anchor", "id", "label", "v", *[c for c, _ in extra])
    return own.unionByName(sent).repartition(blocks, "blk").sortWithinPartitions("blk", F.col("anchor").asc_nulls_first())


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Block:
    """One block's candidates by vector length, ids ascending, so that the first of equal scores is the smaller id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        vectors = table.column("v").combine_chunks()
        size = pc.list_value_length(vectors).to_numpy()
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]] = {}
        labels = np.array(table.column("label").to_pylist(), object)
        ids = table.column("id").to_numpy()
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            x = _matrix(vectors.take(pa.array(at)), width)
            self.of[width] = (ids[at], labels[at], x, float(np.sqrt((x * x).sum(1).max())))

    def scores(self, width: int, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first anchor, scores of some anchors against all candidates), so many at once as fit."""
        _, _, x, longest = self.of[width]
        step = max(1, PRODUCTS // len(x))
        for lo in range(0, len(anchors), step):
            some = anchors[lo : lo + step]
            if float(np.sqrt((some * some).sum(1).max())) * longest < EXACT:
                yield lo, (some @ x.T).astype(np.int64)
            else:
                yield lo, some.astype(np.int64) @ x.T.astype(np.int64)


def _scan(met: DataFrame, schema: T.StructType, work) -> DataFrame:
    """``work(block, anchors)`` for every block and every batch of anchors that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, block = None, None
        for batch in batches:
            own = batch.column("blk").to_numpy()
            isnull = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (isnull[1:] != isnull[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(own)].tolist(), strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if number != own[lo]:
                    number, held, block = own[lo], [], None
                if isnull[lo]:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = _Block(pa.Table.from_batches(held)), []
                if block is not None:
                    yield from work(block, part)

    return met.mapInArrow(run, schema)


def _by_width(part: pa.RecordBatch, block: _Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places of the anchors of that width, their vectors), where the block has any such rows."""
    vectors = part.column("v")
    size = pc.list_value_length(vectors).to_numpy()
    for width in np.unique(size).tolist():
        if width in block.of:
            at = np.flatnonzero(size == width)
            yield width, at, _matrix(vectors.take(pa.array(at)), width)


def _first(score: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """The k of ``which`` with the highest score, equal ones in order of place."""
    if len(which) > k:
        least = np.partition(score[which], len(which) - k)[len(which) - k]
        above, level = which[score[which] > least], which[score[which] == least]
        which = np.concatenate([above, level[: k - len(above)]])
    return which[np.lexsort((which, -score[which]))]


_POSITIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "positive_id", "positive_score")])
_NEGATIVE = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "place", "positive_id", "positive_score", "negative_id", "negative_score")])


def _batch(schema: T.StructType, columns: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if columns:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[i] for c in columns]), pa.int64()) for i in range(len(schema))], names=[f.name for f in schema])


def _positives(k: int):
    def work(block: _Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors, own = part.column("anchor").to_numpy(), part.column("id").to_numpy()
        label, out = part.column("label").to_pylist(), []
        for width, at, vectors in _by_width(part, block):
            ids, labels, _, _ = block.of[width]
            same = {name: labels == name for name in {label[i] for i in at.tolist()}}
            for lo, scores in block.scores(width, vectors):
                for i, score in zip(at[lo : lo + len(scores)].tolist(), scores, strict=True):
                    best = _first(score, np.flatnonzero(same[label[i]] & (ids != own[i])), k)
                    out.append([np.full(len(best), anchors[i]), ids[best], score[best]])
        yield from _batch(_POSITIVE, out)

    return work


def _negatives(k: int, low: int, high: int):
    def work(block: _Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors, label, found, out = part.column("anchor").to_numpy(), part.column("label").to_pylist(), part.column("found").to_pylist(), []
        for width, at, vectors in _by_width(part, block):
            ids, labels, _, _ = block.of[width]
            other = {name: labels != name for name in {label[i] for i in at.tolist()}}
            for lo, scores in block.scores(width, vectors):
                for i, score in zip(at[lo : lo + len(scores)].tolist(), scores, strict=True):
                    for one in found[i]:
                        top = one["positive_score"]
                        # in whole numbers: low * top <= 100 * score <= high * top
                        inside = (score >= -((-low * top) // 100)) & (score <= (high * top) // 100)
                        best = _first(score, np.flatnonzero(inside & other[label[i]]), k)
                        if len(best):
                            n = len(best)
                            out.append([np.full(n, anchors[i]), np.full(n, one["place"]), np.full(n, one["positive_id"]), np.full(n, top), ids[best], score[best]])
        yield from _batch(_NEGATIVE, out)

    return work


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells which rows (by ``id``) are anchors, the stated query set; ``label`` is the column
    or expression that rows are told apart by. Equal scores go by the smaller id.
    """
    spark = rows.sparkSession
    textkit.bound_batches(spark)
    folder = workspace(spark, "negatives")
    label = F.col(label) if isinstance(label, str) else label
    kept = materialize(sound(rows, key, vector, label, scale), folder, "rows")
    n, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tasks = spark.sparkContext.defaultParallelism
    blocks = -(-n // block_rows) if block_rows else max(-(-n * width * 8 // BLOCK_BYTES), min(2 * tasks, n // LEAST_ROWS))
    blocks = max(1, blocks)
    # numbered once and written: an id that repeats is several anchors
    asked = materialize(kept.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()), folder, "anchors")

    near = _scan(_meet(kept, asked, blocks, []), _POSITIVE, _positives(positives))
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    top = near.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= positives)
    found = F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found")
    led = materialize(asked.join(top.groupBy("anchor").agg(found), "anchor"), folder, "positives")

    kind = "array<struct<place:bigint,positive_id:bigint,positive_score:bigint>>"
    hard = _scan(_meet(kept, led, blocks, [("found", kind)]), _NEGATIVE, _negatives(negatives, low, high))
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = asked.select("anchor", F.col("id").alias("anchor_id"))
    return ranked.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
