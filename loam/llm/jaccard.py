"""N-gram Jaccard join with Bayesian candidate pruning (after Satuluri & Parthasarathy, 2012).

1. Every text becomes its set of shingles of five words and ``HASHES`` MinHash values of it.
   Texts with the same set are one class.
2. ``BANDS`` bands of the values make buckets. Bucket mates are compared ``STEP`` values at a
   time; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold, given the matches so far, is below ``TOLERANCE``. What is
   left gives edges that span groups of likely neighbours.
3. Inside each connected group the pairs are pruned in the same way, whichever band they met in
   or none, and those that survive are verified exactly on their whole shingle sets, by counting
   common shingles in blocks of bounded bytes; links are summed per document, and the verified
   links give the final groups. No pair of documents becomes a row.

A pair at the threshold is missed by all bands with probability (1 - 0.8^4)^24 = 3e-6, and pruned
with ``TOLERANCE`` at most. Shingles are compared by 64-bit hashes; words over 512 bytes enter by a
cryptographic digest.

Defined results: words are runs of anything but white space; a text of one to four words has
one shingle, of all its words; a null text or one without words links with nothing and is its
own class; repeated rows count as copies; a null doc_id still joins its copies' class (the
smallest doc_id names it, or a hash where all are null; a group's smallest doc_id comes before any
hash, and one row stands for a group without a doc_id); different texts must have different ids;
other columns are not read.
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

WORDS = 5
THRESHOLD = 0.8
ROWS_A_BAND = 4
BANDS = 24
HASHES = ROWS_A_BAND * BANDS
STEP = 16
TOLERANCE = 1e-6
#: Candidates compared, and bytes and rows verified, in one block (a task holds a pair of blocks).
BUCKET_BLOCK = 2048
VERIFY_BLOCK = 4 << 20
VERIFY_ROWS = 1024
#: Rows of a block, and shingles, that are compared at once.
STRIPE = 64
COLUMNS = 2048


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair). With a uniform prior the posterior
    P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, least = 0.0, n + 1
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((n, least))
    return out


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    high = np.iinfo(np.uint64).max
    return rng.integers(0, high, HASHES, np.uint64) | np.uint64(1), rng.integers(0, high, HASHES, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted by document and shingle, and their documents."""
    starts, ends, doc = textkit.word_bounds(data, offsets)
    value, where = textkit.shingles(textkit.word_hashes(data, starts, ends), doc, len(offsets) - 1, WORDS)
    if not len(value):
        return value, where
    order = np.lexsort((value, where))
    value, where = value[order], where[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (where[1:] != where[:-1])
    return value[new], where[new]


def signatures(value: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets, two 64-bit digests of each set, and MinHash values (n by HASHES, 32 bits)."""
    size = np.bincount(where, minlength=n)
    has = np.flatnonzero(size)
    first = np.concatenate([[0], np.cumsum(size[has])[:-1]]).astype(np.int64) if len(has) else np.zeros(0, np.int64)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    least = np.zeros((n, HASHES), np.uint32)
    if len(has):
        one[has] = np.add.reduceat(textkit.mix64(value + np.uint64(1)), first)
        two[has] = np.bitwise_xor.reduceat(textkit.mix64(value * np.uint64(3)), first) ^ textkit.mix64(size[has].astype(np.uint64))
        for k, (a, b) in enumerate(zip(*_coefficients(), strict=True)):
            mixed = value * a + b
            mixed ^= mixed >> np.uint64(29)
            least[has, k] = np.minimum.reduceat(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32), first)
    return size, one, two, least


def band_keys(least: np.ndarray) -> np.ndarray:
    """64-bit bucket ids, n by BANDS."""
    key = np.empty((len(least), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(least), band + 1, np.uint64)
        for k in range(ROWS_A_BAND):
            value = textkit.mix64(value * np.uint64(0x9E3779B97F4A7C15) + least[:, band * ROWS_A_BAND + k])
        key[:, band] = value
    return key


def _likely(one: np.ndarray, others: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of ``others`` survive the comparison with ``one`` step by step."""
    alive = np.arange(len(others))
    matches = np.zeros(len(others), np.int64)
    for n, least in limits:
        matches = matches + (others[alive, n - STEP : n] == one[n - STEP : n]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    out = np.zeros(len(others), bool)
    out[alive] = True
    return out


SKETCH = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())]
)
DIGESTED = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("text", T.StringType())])
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
BUCKET = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("member", T.LongType())])
VERIFIED = T.StructType([T.StructField("id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("label", T.LongType()), T.StructField("split", T.BooleanType())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textkit.string_bytes(batch.column(1))
        for lo, hi in textkit.slices(offsets):
            value, where = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size, one, two, least = signatures(value, where, hi - lo)
            packed = least.astype("<u4").tobytes()
            width = HASHES * 4
            sig = [packed[k * width : (k + 1) * width] for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(sig, pa.binary())], names=[f.name for f in SKETCH])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by the digests of their sets, for rows that no doc_id names."""
    for batch in batches:
        data, offsets = textkit.string_bytes(batch.column(0))
        for lo, hi in textkit.slices(offsets):
            value, where = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            _, one, two, _ = signatures(value, where, hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(0).slice(lo, hi - lo)], names=[f.name for f in DIGESTED])


def _unpack(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), HASHES)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_unpack(batch.column(1)))
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "member"])


def _mates(limits: list[tuple[int, int]]):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, blk, bi, bj = (column(c) for c in ("id", "blk", "bi", "bj"))
        bounds = groups.group_bounds([column("bucket"), bi, bj])
        sig = _unpack(table.column("sig"))
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]  # most buckets: one comparison for all of them
        ok = np.ones(len(two), bool)
        for n, least in limits:
            ok &= (sig[two, :n] == sig[two + 1, :n]).sum(1) >= least
        out = list(zip(ids[two[ok]].tolist(), ids[two[ok] + 1].tolist(), strict=True))
        for lo, hi in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
            part, at = sig[lo:hi], blk[lo:hi]
            allowed = (lambda i, js, at=at: at[js] != at[i]) if bi[lo] != bj[lo] else None
            pairs = groups.spanning(hi - lo, lambda i, js, part=part: _likely(part[i], part[js], limits), allowed)
            out += [(int(ids[lo + i]), int(ids[lo + j])) for i, j in pairs]
        if not out:
            return None
        ends = np.unique(np.array(out, np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return work


def common(value: np.ndarray, where: np.ndarray, n: int, columns: int = COLUMNS) -> np.ndarray:
    """Numbers of common shingles of all pairs of ``n`` sets."""
    order = np.argsort(value, kind="stable")
    value, where = value[order], where[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    place = np.cumsum(new) - 1
    shared = (np.bincount(place) > 1)[place]  # a shingle of one set alone is common to none
    place, where = place[shared], where[shared]
    out = np.zeros((n, n), np.float32)
    if not len(place):
        return out
    place = np.cumsum(np.diff(place, prepend=place[0]) > 0)
    edges = np.searchsorted(place, np.arange(0, place[-1] + columns + 1, columns))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        rows, local = np.unique(where[lo:hi], return_inverse=True)
        block = np.zeros((len(rows), columns), np.float32)
        block[local, place[lo:hi] - k * columns] = 1
        for at in range(0, len(rows), 4 * STRIPE):
            out[np.ix_(rows[at : at + 4 * STRIPE], rows)] += block[at : at + 4 * STRIPE] @ block.T
    return out


def survivors(sig: np.ndarray, limits: list[tuple[int, int]], side: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of rows survive the step-by-step comparison; with ``side``, of rows of two sides only."""
    n = len(sig)
    out = np.zeros((n, n), bool)
    for lo in range(0, n, STRIPE):
        mine = sig[lo : lo + STRIPE]
        alive = np.ones((len(mine), n), bool) if side is None else side[lo : lo + STRIPE, None] != side[None, :]
        alive[np.arange(len(mine)), np.arange(lo, lo + len(mine))] = False
        columns = np.flatnonzero(alive.any(0))
        matches, alive = np.zeros((len(mine), len(columns)), np.uint8), alive[:, columns]
        for m, least in limits:
            theirs = sig[columns]
            for k in range(m - STEP, m):
                matches += mine[:, k, None] == theirs[None, :, k]
            alive &= matches >= least
            left = alive.any(0)
            if not left.all():
                columns, matches, alive = columns[left], matches[:, left], alive[:, left]
            if not len(columns):
                break
        out[lo : lo + STRIPE, columns] = alive
    return out


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` slice by slice."""
    values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for lo, hi in textkit.slices(offsets):
        value, where = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        values.append(value)
        owners.append((where + lo).astype(np.int32))
    return np.concatenate(values), np.concatenate(owners)


def verified_links(data: np.ndarray, offsets: np.ndarray, sig: np.ndarray, limits: list[tuple[int, int]], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of texts (with ``side``, of two sides) whose sets reach the threshold: the pruned
    ones are left out, every other pair is settled by its common shingles."""
    linked = survivors(sig, limits, side)
    busy = np.flatnonzero(linked.any(1))
    if not len(busy):
        return linked
    value, where = _sets(data, offsets)
    size = np.bincount(where, minlength=len(sig)).astype(np.float64)[busy]
    place = np.full(len(sig), -1, np.int32)
    place[busy] = np.arange(len(busy))
    wanted = place[where] >= 0
    both = common(value[wanted], place[where[wanted]], len(busy))
    for lo in range(0, len(busy), STRIPE):
        part = both[lo : lo + STRIPE].astype(np.float64)
        enough = (part >= threshold * (size[lo : lo + STRIPE, None] + size[None, :] - part) - 1e-9) & (part > 0)
        linked[np.ix_(busy[lo : lo + STRIPE], busy)] &= enough
    return linked


def _verify(threshold: float, limits: list[tuple[int, int]]):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, comp, copies, blk, bi, bj, blocks = (column(c) for c in ("id", "component", "copies", "blk", "bi", "bj", "n_blocks"))
        bounds = groups.group_bounds([comp, bi, bj])
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo == 1:
                continue
            group = table.slice(lo, hi - lo)
            data, offsets = textkit.string_bytes(group.column("text").combine_chunks())
            linked = verified_links(data, offsets, _unpack(group.column("sig")), limits, threshold, blk[lo:hi] if bi[lo] != bj[lo] else None)
            for at in range(0, hi - lo, STRIPE):
                links[lo + at : min(lo + at + STRIPE, hi)] = linked[at : at + STRIPE] @ copies[lo:hi]
            label[lo:hi] = groups.least_reached(ids[lo:hi], linked)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(label), pa.array(blocks > 1)], names=[f.name for f in VERIFIED])

    return work


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, kept) of every row of (doc_id, text).

    ``class_id``: smallest doc_id of the group within reach of links; ``copy_of``: smallest
    doc_id with the same set of shingles; ``n_links``: other documents linked directly;
    ``kept``: this row stands for its group.
    """
    spark = df.sparkSession
    folder = workspace(spark, "jaccard")
    textkit.bound_batches(spark)
    documents = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(documents.mapInArrow(_sketch, SKETCH), folder, "sketch")
    classes = (
        sketch.filter("n_shingles > 0").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select("h1", "h2", F.coalesce("least", F.xxhash64("h1", "h2")).alias("id"), F.col("least").isNull().alias("nameless"), "copies", "n_shingles", "sig")
    )
    classes = materialize(classes, folder, "classes")
    some_nameless = not classes.filter("nameless").limit(1).isEmpty()
    spread = materialize(classes.select("id", "sig").mapInArrow(_band_rows, BUCKET), folder, "buckets")
    full = groups.blocks(spread, ["bucket"], F.lit(1), BUCKET_BLOCK, folder, "buckets", least=2)
    members = spread.join(full, "bucket").join(classes.select("id", "sig"), F.col("member") == F.col("id")).select("bucket", "n_blocks", "id", "sig")
    limits = least_matches(threshold)
    edges = materialize(groups.scan(groups.deal(members, ["bucket"], "id"), ["bucket"], EDGE, _mates(limits)), folder, "edges")
    grouped = groups.components(edges, folder)
    chosen = grouped.join(classes.select(F.col("id").alias("own"), "h1", "h2", "nameless", "copies", "sig"), F.col("id") == F.col("own")).drop("own")
    # the text of one row of each class: the first of the rows that carry its smallest doc_id
    chosen = materialize(chosen, folder, "chosen")
    # merged at every size: whether the ids fit a broadcast must not decide how this grows
    texts = documents.join(chosen.filter("not nameless").select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    texts = texts.withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
    if some_nameless:
        unnamed = documents.filter("doc_id is null and text is not null").select("text").mapInArrow(_digested, DIGESTED)
        unnamed = unnamed.groupBy("h1", "h2").agg(F.max("text").alias("text")).join(chosen.filter("nameless").select("h1", "h2", "id"), ["h1", "h2"])
        texts = texts.unionByName(unnamed.select(F.col("id").alias("doc_id"), "text"))
    payload = texts.join(chosen, F.col("doc_id") == F.col("id")).select("component", "id", "copies", "sig", "text")
    payload = materialize(payload, folder, "payload")  # read twice: for the blocks, and dealt into them
    weight = F.greatest(F.octet_length("text"), F.lit(VERIFY_BLOCK // VERIFY_ROWS))
    dealt = groups.deal(payload.join(groups.blocks(payload, ["component"], weight, VERIFY_BLOCK, folder, "verify"), "component"), ["component"], "id")
    verified = groups.scan(dealt, ["component"], VERIFIED, _verify(threshold, limits), 512)
    verified = materialize(verified, folder, "verified")
    result = verified.groupBy("id").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    across = verified.filter("split and id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    if not across.isEmpty():  # groups over several blocks: their pieces' links meet once more
        joined = groups.components(across, folder, "across").withColumnRenamed("id", "own")
        result = result.join(joined, F.col("id") == F.col("own"), "left").select("id", "links", F.coalesce("component", "label").alias("label"))
    known = classes.select("h1", "h2", "id", "nameless", "copies").join(result.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left")
    known = known.select("h1", "h2", "id", "nameless", F.coalesce("label", "id").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    rows = sketch.drop("sig").withColumn("first", F.lit(False))
    if some_nameless:  # a group is named by its smallest doc_id, hashes being none
        known = materialize(known, folder, "known")
        named = known.filter("not nameless").groupBy("label").agg(F.min("id").alias("named"))
        known = known.join(named, "label", "left").withColumn("label", F.coalesce("named", "label")).drop("named")
        numbered = materialize(rows.filter("doc_id is null").withColumn("n", F.monotonically_increasing_id()), folder, "nameless")
        firsts = numbered.groupBy("h1", "h2").agg(F.min("n").alias("least_n"))
        numbered = numbered.join(firsts, ["h1", "h2"]).withColumn("first", F.col("n") == F.col("least_n"))
        rows = rows.filter("doc_id is not null").unionByName(numbered.select(*rows.columns))
    out = rows.join(known, ["h1", "h2"], "left").withColumn("copy_of", F.coalesce("id", "doc_id")).withColumn("class_id", F.coalesce("label", "doc_id"))
    return out.select(
        "doc_id", "class_id", "copy_of", F.when(F.col("n_shingles") > 0, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        ((F.col("n_shingles") == 0) | F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("first") & F.col("nameless") & (F.col("id") == F.col("class_id")), F.lit(False))).alias("kept"),
    )
