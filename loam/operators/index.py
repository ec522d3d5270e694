"""A vector index: cells around centroids, written as partitions, of which a search reads those it needs.

Centroids are fitted to a bounded sample; every row of the table lies in the cell of its nearest centroid, and each
cell's radius is kept. A search probes the nearest cells of each question; an exact one then goes on
to every cell that may hold a better row than the k-th at hand: no row of a cell is nearer to a question than the
question's distance to the centroid less the radius. Cells are partitions of the stored table, so what is not
probed is not read. Cells that are large are held in parts of bounded size.

Defined results: rows without a key or a vector, or with a null or non-finite component, are not indexed, nor are those
of another length than most of the sample; questions like that find nothing; equal scores (to six digits) go by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.store import materialize, workspace

#: Rows that centroids are fitted to, cells at most, rounds of fitting, rows of a part of a cell.
SAMPLE, CELLS, ROUNDS, PART = 20_000, 1024, 8, 50_000
SLACK = 2e-6
PRODUCTS = 1 << 20


def _units(vectors: pa.Array, width: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def fitted(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors: Lloyd's rounds from rows drawn at random; an empty cell gets the farthest row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T - (centres * centres).sum(1) / 2
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))
        far = np.argsort(near.max(1))
        centres = sums / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[far[: len(empty)]]
    return centres


def _sound(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    rows = df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v")).filter(f"{name} is not null and size(v) > 0")
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


@dataclass
class VectorIndex:
    """``rows``: (id, v, part, cell), partitioned by cell; ``cells``: (cell, centre, radius), one row a cell that is not empty."""

    rows: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, folder: str, cells: int | None = None) -> VectorIndex:
        spark = df.sparkSession
        source = materialize(_sound(df, key, vector, "id"), folder, "source")
        n = source.count()
        some = source.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        widths = pc.list_value_length(some).to_numpy()
        width = int(np.bincount(widths).argmax()) if len(widths) else 1
        x = _units(some.filter(pa.array(widths == width)), width)
        cells = cells or int(min(CELLS, max(1, np.sqrt(n))))
        centres = spark.sparkContext.broadcast(fitted(x, cells) if len(x) else np.zeros((1, width)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.flatnonzero(pc.list_value_length(batch.column("v")).to_numpy() == width)
                batch, c = batch.take(pa.array(at)), centres.value
                v = _units(batch.column("v"), width)
                far = np.maximum(0.0, (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * v @ c.T)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(far[np.arange(len(own)), own])), pa.array(own.astype(np.int32))], names=["id", "v", "distance", "cell"])

        kind = source.schema["id"].dataType.simpleString()
        held = materialize(source.mapInArrow(place, f"id {kind}, v array<double>, distance double, cell int"), folder, "placed")
        sizes = held.groupBy("cell").agg(F.max("distance").alias("radius"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        sizes = materialize(sizes, folder, "sizes")
        dealt = held.join(sizes, "cell").select("id", "v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "cell")
        dealt.repartition("cell", "part").write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{folder}/rows")
        where = spark.createDataFrame([(k, [float(e) for e in c]) for k, c in enumerate(centres.value)], "cell int, centre array<double>")
        materialize(where.join(sizes, "cell").select("cell", "centre", "radius", "parts"), folder, "cells")
        return cls.load(spark, folder, kind)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, kind: str = "bigint") -> VectorIndex:
        return cls(spark.read.schema(f"id {kind}, v array<double>, part int, cell int").parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/cells"))

    def _near(self, asked: DataFrame, probes: int | None, least: bool) -> DataFrame:
        """(qid, v, cell, parts, probed): the ``probes`` nearest cells of each question, or those that may hold a row at
        least as good as its ``least`` score, of which the first ones are ``probed`` already."""
        known = self.cells.orderBy("cell").collect()  # no more rows than CELLS
        spark = asked.sparkSession
        table = spark.sparkContext.broadcast((np.array([r.cell for r in known]), np.array([r.centre for r in known]), np.array([r.radius for r in known]), np.array([r.parts for r in known])))
        first = probes or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, centre, radius, parts = table.value
            width = centre.shape[1] if len(cell) else -1
            for batch in batches:
                at = np.flatnonzero(pc.list_value_length(batch.column("v")).to_numpy() == width)
                batch = batch.take(pa.array(at))
                v = _units(batch.column("v"), max(1, width)) if len(at) else np.zeros((0, max(1, width)))
                far = np.sqrt(np.maximum(0.0, (v * v).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2 * v @ centre.T)) if len(at) else np.zeros((0, len(cell)))
                nth = far.argsort(1, kind="stable").argsort(1, kind="stable")
                if least:
                    # unit vectors at a distance d have a cosine of 1 - d^2 / 2
                    bound = 1 - np.maximum(0.0, far - radius[None, :]) ** 2 / 2
                    want = (nth >= first) & (bound >= batch.column("least").to_numpy()[:, None] - SLACK)
                else:
                    want = nth < first
                row, c = np.nonzero(want)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("qid"), taken.column("v"), pa.array(cell[c].astype(np.int32)), pa.array(parts[c].astype(np.int32))], names=["qid", "v", "cell", "parts"])

        kind = asked.schema["qid"].dataType.simpleString()
        return asked.mapInArrow(run, f"qid {kind}, v array<double>, cell int, parts int")

    def _best(self, near: DataFrame, k: int) -> DataFrame:
        """(qid, id, similarity): the k best rows of each part of the probed cells."""
        some = [r.cell for r in near.select("cell").distinct().collect()]  # no more than CELLS; partitions not named are not read
        asked = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        qid, id_ = (f.dataType.simpleString() for f in (near.schema["qid"], self.rows.schema["id"]))

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                vectors = left.column("v").combine_chunks()
                width = len(vectors[0])
                x, q = _units(vectors, width), _units(right.column("v").combine_chunks(), width)
                order = np.argsort(np.array(left.column("id").to_pylist(), object), kind="stable")
                for lo in range(0, len(q), step := max(1, PRODUCTS // len(x))):
                    score = np.round(q[lo : lo + step] @ x.T, 6)[:, order]
                    first = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    rows = np.repeat(np.arange(lo, lo + len(score)), first.shape[1])
                    out.append(pa.table({"qid": right.column("qid").take(pa.array(rows)), "id": left.column("id").take(pa.array(order[first.ravel()])), "similarity": np.take_along_axis(score, first, 1).ravel()}))
            return pa.concat_tables(out) if out else pa.table({"qid": right.column("qid").slice(0, 0), "id": left.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})

        rows = self.rows.filter(F.col("cell").isin(some)) if some else self.rows.limit(0)
        return rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(work, f"qid {qid}, id {id_}, similarity double")

    def search(self, questions: DataFrame, key: str, vector: str, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(qid, id, similarity, rank): for each question the ``k`` rows of largest cosine among its ``probes`` nearest cells, or,
        ``exact``, among all."""
        folder = workspace(questions.sparkSession, "search")
        asked = materialize(_sound(questions, key, vector, "qid"), folder, "asked")
        order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = materialize(ranked(self._best(materialize(self._near(asked, probes, False), folder, "near"), k)), folder, "first")
        if not exact:
            return found
        kth = found.filter(F.col("rank") == k).select("qid", F.col("similarity").alias("least"))
        more = asked.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        rest = self._best(materialize(self._near(more, probes, True), folder, "rest"), k)
        return ranked(found.drop("rank").unionByName(rest))
