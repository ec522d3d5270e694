"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

Equal vectors of one label are one class. A vector's hash is, per function, the axis (with its
sign) that it is nearest to after three rounds of random signs and a fast Hadamard transform;
``k`` functions make a bucket, ``tables`` independent buckets a vector. Multiprobe: a vector
also looks into the buckets in which one of its ``k`` axes is replaced by the second nearest.
Rows of buckets carry a sketch of ``BITS`` signs instead of the vector; bucket mates whose sketches
differ in more bits than a pair at the threshold ever does (``SIGMAS`` deviations over the mean) are
dropped, and what is left gives edges that span candidate groups. Inside each group all pairs are
verified by their cosine in double precision, in blocks of bounded size; the verified links are
counted and make the components. So a group's links are all of them, whichever pairs met in buckets.

``plan`` sets k so that about ``LOAD`` unrelated vectors meet in a bucket at most, and then as many
tables as leave a pair at the threshold unfound once in ``1 / MISS`` cases, from collision rates
measured on the spot.

Defined results: a vector that is null, zero, or has null or non-finite components, or has a
null label, links with nothing; vectors of different length do not link; an empty table gives
no rows; ids must be distinct integers (a null id gets no links); other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm import groups, textkit
from loam.llm.store import materialize, workspace

COSINE = 0.93
MISS = 1e-4
LOAD = 16
BITS = 128
WORDS = tuple(f"sketch{k}" for k in range(BITS // 64))
#: Buckets of so many rows at most are compared without a step of Python each: all that go in one block.
FEW = 128
SIGMAS = 6
#: Vectors of a bucket or component compared in one task at most.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    return _rotated(x.T).T


def _rotated(y: np.ndarray) -> np.ndarray:
    """The transform of every column: its steps add and subtract whole rows of ``y``."""
    width, n = y.shape
    h = 1
    while h < width:
        pairs = y.reshape(-1, 2, h, n)
        y = np.empty_like(pairs, order="C")
        np.add(pairs[:, 0], pairs[:, 1], out=y[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=y[:, 1])
        y = y.reshape(width, n)
        h *= 2
    return y / math.sqrt(width)


class Hasher:
    def __init__(self, dim: int, k: int, tables: int, seed: int = 5):
        self.width, self.k, self.tables = 1 << max(1, (dim - 1).bit_length()), k, tables
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(tables * k, 3, self.width))
        self.planes = rng.normal(size=(dim, BITS))

    def axes(self, x: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest and the second nearest signed axis of each row under function ``which``."""
        y = np.zeros((self.width, len(x)))
        y[: x.shape[1]] = x.T
        for signs in self.signs[which]:
            y = _rotated(y * signs[:, None])
        size = np.abs(y)
        rows = np.arange(len(x))
        first = size.argmax(0)
        size[first, rows] = -1
        second = size.argmax(0)
        return first * 2 + (y[first, rows] > 0), second * 2 + (y[second, rows] > 0)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """``BITS`` sides of random planes, in 64-bit words."""
        return np.packbits(x @ self.planes > 0, axis=1).view(np.uint64)

    def buckets(self, x: np.ndarray, salt: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """64-bit bucket ids of each row: its own of each table, then the probed ones."""
        for table in range(self.tables):
            found = [self.axes(x, table * self.k + f) for f in range(self.k)]
            for probe in range(-1, self.k):
                key = salt ^ np.uint64(table + 1)
                for f, (first, second) in enumerate(found):
                    key = (key ^ (second if f == probe else first).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield key, probe < 0


def plan(rows: int, dim: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(k, tables) for so many rows."""
    rng = np.random.default_rng(1)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 4000, dim)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    hasher = Hasher(dim, 1, 1)
    (a1, a2), (b1, b2) = hasher.axes(a, 0), hasher.axes(b, 0)
    same, near = float((a1 == b1).mean()), float(((a1 != b1) & ((a2 == b1) | (a1 == b2))).mean())
    k = 2
    while rows * (k + 1) / LOAD > (2 * hasher.width) ** k and k < 8:
        k += 1
    hit = same**k + k * same ** (k - 1) * near
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - min(hit, 0.999))))


def most_bits(cosine: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by a power of two first, so that squares neither overflow nor vanish
    and no digit is lost."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = df.sparkSession
    folder = workspace(spark, "vectors")
    textkit.bound_batches(spark)
    element = df.schema["embedding"].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    rows = df.select("vec_id", "label", F.col("embedding").cast(f"array<{element}>").alias("v"))
    # the largest component is NaN where any is
    low, high = F.array_min("v"), F.array_max("v")
    finite = ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & ((high != 0) | (low != 0)) & ~F.exists("v", F.isnull)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keys = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2")]
    rows = rows.select("vec_id", "label", "sound", F.when(F.col("sound"), F.col("v")).alias("v"), *keys)
    classes = rows.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes, folder, "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = [r.d for r in lengths if r.n > 1]  # a vector alone in its length links with none
    if len(dims) == 1:  # so in practice; vectors of different length never link
        links = _links(classes.filter(F.size("v") == dims[0]), dims[0], cosine, folder)
    else:  # written one by one, so that the plan does not grow with the lengths
        links = spark.createDataFrame([], "id long, links long, component long")
        for dim in dims:
            _links(classes.filter(F.size("v") == dim), dim, cosine, folder).select(*links.columns).write.mode("append").parquet(f"{folder}/links")
        links = spark.read.schema(links.schema).parquet(f"{folder}/links") if dims else links
    links = links.groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    known = classes.select("h1", "h2", "id", "copies").join(links, "id", "left")
    known = known.select(
        "h1", "h2", F.lit(True).alias("sound"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "id").alias("c")
    )
    out = rows.drop("v", "label").join(known, ["h1", "h2", "sound"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(classes: DataFrame, dim: int, cosine: float, folder: str) -> DataFrame:
    """(id, links, component) of the classes that link with others; links count rows."""
    k, tables = plan(classes.count(), dim, cosine)
    hasher = Hasher(dim, k, tables)
    light = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.LongType()), ("id", T.LongType()), ("own", T.BooleanType()), *((w, T.LongType()) for w in WORDS))])
    limit = most_bits(cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = batch.column(0), batch.num_rows
            salt = batch.column(1).to_numpy().view(np.uint64)
            x = _unit(_matrix(batch.column(2), dim))
            sketch = [pa.array(word) for word in np.ascontiguousarray(hasher.sketch(x).view(np.int64).T)]
            for key, own in hasher.buckets(x, salt):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, pa.array(np.full(n, own)), *sketch], names=[f.name for f in light])

    spread = materialize(classes.select("id", F.xxhash64("label").alias("salt"), "v").mapInArrow(hashed, light), folder, f"buckets-{dim}")
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def mates(table: pa.Table) -> pa.RecordBatch | None:
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, own, blk, bi, bj = (column(c) for c in ("id", "own", "blk", "bi", "bj"))
        bounds = groups.group_bounds([column("bucket"), bi, bj])
        bits = np.stack([column(w) for w in WORDS], 1).view(np.uint64)
        size = np.diff(bounds)
        few = (size <= FEW) & (bi[bounds[:-1]] == bj[bounds[:-1]])  # nearly all buckets: compared side by side
        until = np.where(np.repeat(few, size), np.repeat(bounds[1:], size), 0)
        alike = [np.zeros((2, 0), np.int64)]
        for step in range(1, size[few].max(initial=1)):
            i = np.flatnonzero(until > np.arange(len(ids)) + step)
            i = i[(own[i] | own[i + step]) & (np.bitwise_count(bits[i] ^ bits[i + step]).sum(1) <= limit)]
            alike.append(np.stack([i, i + step]))
        root = groups.first_reached(len(ids), *np.concatenate(alike, axis=1))
        hung = np.flatnonzero(root != np.arange(len(ids)))
        ends = np.stack([ids[root[hung]], ids[hung]], 1)
        out: list[tuple[int, int]] = []
        for lo, hi in zip(bounds[:-1][~few].tolist(), bounds[1:][~few].tolist(), strict=True):
            part, mine, at = bits[lo:hi], own[lo:hi], blk[lo:hi]
            cross = bi[lo] != bj[lo]

            def like(i: int, js: np.ndarray, part=part) -> np.ndarray:
                return np.bitwise_count(part[js] ^ part[i]).sum(1) <= limit

            def allowed(i: int, js: np.ndarray, mine=mine, at=at, cross=cross) -> np.ndarray:
                return (mine[i] | mine[js]) & ((at[js] != at[i]) if cross else True)

            out += [(int(ids[lo + i]), int(ids[lo + j])) for i, j in groups.spanning(hi - lo, like, allowed)]
        pairs = np.unique(np.concatenate([ends, np.array(out, np.int64).reshape(-1, 2)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    full = groups.blocks(spread, ["bucket"], F.lit(1), BLOCK, folder, f"buckets-{dim}", least=2)
    dealt = groups.deal(spread.join(full, "bucket"), ["bucket"], "id")
    edges = materialize(groups.scan(dealt, ["bucket"], edge, mates), folder, f"edges-{dim}")
    grouped = groups.components(edges, folder, f"cc-{dim}")
    members = grouped.join(classes.select(F.col("id").alias("own_id"), "copies", "v", F.hash("label").alias("salt"), F.xxhash64("label").alias("salt2")), F.col("id") == F.col("own_id")).select("component", "id", "copies", "v", "salt", "salt2")
    counted = T.StructType([T.StructField("id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("label", T.LongType()), T.StructField("split", T.BooleanType())])

    def count(table: pa.Table) -> pa.RecordBatch | None:
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, comp, copies, blk, bi, bj, blocks = (column(c) for c in ("id", "component", "copies", "blk", "bi", "bj", "n_blocks"))
        bounds = groups.group_bounds([comp, bi, bj])
        salt, salt2 = column("salt"), column("salt2")
        x = _unit(_matrix(table.column("v"), dim))
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            linked = x[lo:hi] @ x[lo:hi].T >= cosine
            for of in (salt, salt2):  # labels that met by the hash of a bucket
                if (of[lo:hi] != of[lo]).any():
                    linked &= of[lo:hi, None] == of[None, lo:hi]
            np.fill_diagonal(linked, False)
            if bi[lo] != bj[lo]:
                linked &= blk[lo:hi, None] != blk[None, lo:hi]
            links[lo:hi] = linked @ copies[lo:hi]
            label[lo:hi] = groups.least_reached(ids[lo:hi], linked)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(label), pa.array(blocks > 1)], names=[f.name for f in counted])

    members = materialize(members, folder, f"members-{dim}")
    whole = groups.blocks(members, ["component"], F.lit(1), BLOCK, folder, f"verify-{dim}", smaller=16)
    verified = materialize(groups.scan(groups.deal(members.join(whole, "component"), ["component"], "id"), ["component"], counted, count), folder, f"verified-{dim}")
    result = verified.groupBy("id").agg(F.sum("links").alias("links"), F.min("label").alias("component"))
    across = verified.filter("split and id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    if across.isEmpty():
        return result
    joined = groups.components(across, folder, f"across-{dim}").select(F.col("id").alias("own_id"), F.col("component").alias("whole"))
    return result.join(joined, F.col("id") == F.col("own_id"), "left").select("id", "links", F.coalesce("whole", "component").alias("component"))
