"""Repeated substrings: every byte that an earlier text, or an earlier place of its own, covers goes.

A byte is removed if a run of ``length`` bytes that holds it starts somewhere earlier as well. Equal runs
hold equal anchors: the anchor of a run is the stretch of ``gram`` bytes in it with the smallest hash, so
it depends on the run alone, and one anchor serves all runs that hold it. So suffixes are sorted
from the anchors on, not from every byte:

1. Equal whole texts are settled by digest; only the first of them, its owner, goes on. Owners are numbered in order.
2. Hashes of all anchors are counted in two numbers each (the smallest and the largest tag of their places);
   anchors that no other place shares are done with.
3. Every anchor left becomes a context, the bytes of all its runs. Contexts of a slice of texts that are
   equal are merged before they are shuffled.
4. Sampled splitters range-partition the contexts by the leading bytes of the anchor's suffix, then by
   place, so that one hot stretch of text spreads over many buckets. A bucket sorts its contexts, and
   the runs of those that are not equal as a whole, by multikey quicksort: eight bytes are one symbol, and only
   those still equal are sorted by the next. The first of equal runs stays.
5. Stretches that a bucket begins or ends with may go on in others, as may those cut for their size: the runs that
   were first there are compared across the boundaries by digest.

A bucket holds ``HELD`` bytes of contexts at once, whatever its size; work is that of sorting bytes, never of pairs.

Defined results: null and empty texts have no bytes and nothing is removed; a null doc_id is the smallest; texts
that share a doc_id are ordered by digest, and of rows alike in doc_id and text one comes first; texts
shorter than ``length`` stay; an empty table gives no rows; other columns are not read. A text is held as a
whole by a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import textkit
from loam.llm.store import materialize, workspace
from loam.store import numbered

LENGTH = 100
#: Bytes of contexts that are sorted at once, and of text whose contexts are merged at once.
HELD, SLICE = 4 << 20, 8 << 20
#: Runs that are looked at together: positions fit in the low bits of a key beside a hash.
STRETCH, LOW = 1 << 22, 24


def gram_of(length: int) -> int:
    """Bytes of an anchor: enough to be rare by chance, few enough to be sparse."""
    return max(1, length * 32 // 100)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on, by doubling."""
    m = np.uint64(0x9E3779B97F4A7C15)
    power, part, done, out = m, data.astype(np.uint64) + np.uint64(1), 0, None
    width = 1
    while True:  # part: hashes of ``width`` bytes; out: of the ``done`` bytes that the low bits of gram name
        if gram & width:
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = out[:n] * power + part[done : done + n]
            done += width
        width *= 2
        if width > gram:
            return textkit.mix64(out[: max(0, len(data) - gram + 1)])
        half = width // 2
        n = max(0, len(part) - half)
        part = part[:n] * power + part[half : half + n]
        with np.errstate(over="ignore"):
            power = power * power


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first, last): anchors in order and the starts of the first and last run that each serves."""
    gram = gram_of(length)
    w = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    bounds = offsets[1:] - length + 1  # runs start before these
    for lo in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[lo : lo + STRETCH + length - 1]
        hashes = gram_hashes(part, gram)
        least = (hashes >> np.uint64(LOW) << np.uint64(LOW)) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        # the starts of runs that lie in one text
        docs = slice(int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets[:-1], lo + len(least), "left")))
        begin, end = np.maximum(offsets[:-1][docs], lo) - lo, np.minimum(bounds[docs], lo + len(least)) - lo
        keep = end > begin
        begin, end = begin[keep], end[keep]
        if not len(begin):
            continue
        start = np.arange(int((end - begin).sum())) + np.repeat(begin - np.r_[0, np.cumsum(end - begin)[:-1]], end - begin)
        at = (least[start] & np.uint64((1 << LOW) - 1)).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(start)] - 1
        out.append((hashes[at[first]], at[first] + lo, start[first] + lo, start[last] + lo))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def multikey(data: np.ndarray, start: np.ndarray, size: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The rank of each stretch of bytes inside its class (classes in order, one size in each): equal ones share it.

    Each round sorts those still equal by their next eight bytes, one symbol, and leaves the rest alone.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbols = np.ndarray(len(padded) - 7, ">u8", padded.tobytes(), strides=(1,))
    ordered = np.sort(cls)
    rank = np.searchsorted(ordered, cls)
    active = np.flatnonzero(np.searchsorted(ordered, cls, "right") - rank > 1)
    depth = 0
    while len(active):
        left = size[active] - depth
        active, left = active[left > 0], left[left > 0]
        if not len(active):
            break
        symbol = symbols[start[active] + depth].astype(np.uint64) >> (8 * np.maximum(0, 8 - left)).astype(np.uint64)
        order = np.lexsort((symbol, rank[active]))
        active, symbol = active[order], symbol[order]
        old = rank[active]
        fresh = np.r_[True, old[1:] != old[:-1]]
        new = fresh | np.r_[True, symbol[1:] != symbol[:-1]]
        at = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        many = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[np.repeat(many > 1, many)]
        depth += 8
    return rank


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textkit.string_bytes(column if not column.null_count else column.fill_null(b"" if pa.types.is_binary(column.type) else ""))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows (with ``text``) of about ``SLICE`` bytes, and the bytes of their texts."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(parts):
        table = pa.Table.from_batches(parts)
        data, offsets = textkit.string_bytes(table.column("text").combine_chunks())
        for lo, hi in textkit.slices(offsets, SLICE):
            yield table.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _repeated(texts: DataFrame, length: int) -> DataFrame:
    """(hash) of anchors at more than one place; places of equal texts are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, data, offsets in _slices(batches):
            hashes, at, _, _ = anchored(data, offsets, length)
            if not len(hashes):
                continue
            doc = np.searchsorted(offsets, at, "right") - 1
            key = table.column("key").to_numpy().view(np.uint64)
            tag = textkit.mix64(key[doc] ^ textkit.mix64((at - offsets[doc]).astype(np.uint64) + np.uint64(1))).view(np.int64)
            order = np.argsort(hashes)
            hashes, tag = hashes[order], tag[order]
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            columns = hashes[starts].view(np.int64), np.minimum.reduceat(tag, starts), np.maximum.reduceat(tag, starts)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "low", "high"])

    tagged = texts.select("text", F.xxhash64("text").alias("key")).mapInArrow(run, "hash long, low long, high long")
    return tagged.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("hash")


def _places(texts: DataFrame, length: int) -> DataFrame:
    """(hash, uid, run) of all anchors: ``run`` packs the anchor's place and how far before it its runs start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, data, offsets in _slices(batches):
            hashes, at, first, last = anchored(data, offsets, length)
            if len(hashes):
                doc = np.searchsorted(offsets, at, "right") - 1
                packed = ((at - offsets[doc]) * length + (at - first)) * length + (at - last)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(table.column("uid").to_numpy()[doc]), pa.array(packed)], names=["hash", "uid", "run"])

    return texts.select("uid", "text").mapInArrow(run, "hash long, uid long, run long")


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of bytes one after the other, some thousand at a time."""
    out = [np.zeros(0, np.uint8)]
    for k in range(0, len(start), 4096):
        begin, many = start[k : k + 4096], size[k : k + 4096]
        before = np.cumsum(many) - many
        out.append(data[np.arange(int(many.sum())) + np.repeat(begin - before, many)])
    return np.concatenate(out)


_CONTEXT = "place long, lo long, hi long, lead int, body binary"


def _contexts(marked: DataFrame, length: int) -> DataFrame:
    """Contexts of (place, text, runs): bytes ``lo`` to ``hi`` of a text and how far into them the anchor is. A null
    ``body`` stands for one whose equal came earlier in the slice: a span to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, data, offsets in _slices(batches):
            runs = table.column("runs").combine_chunks()
            doc = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            packed = runs.flatten().to_numpy()
            at, back, last = packed // (length * length), packed // length % length, packed % length
            lo, hi = at - back, at - last + length
            place = table.column("place").to_numpy()[doc]
            start = offsets[doc] + lo
            rank = multikey(data, start, hi - lo, back * (2 * length) + (hi - lo))
            order = np.lexsort((lo, place, rank))
            later = np.zeros(len(order), bool)
            later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
            size = np.where(later, 0, hi - lo)
            bounds = np.r_[0, np.cumsum(size)]
            bodies = _gathered(data, start, size)
            body = pa.Array.from_buffers(pa.binary(), len(size), [pa.array(~later).buffers()[1], pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(bodies)])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(lo), pa.array(hi), pa.array(back.astype(np.int32)), body], names=["place", "lo", "hi", "lead", "body"])

    return marked.mapInArrow(run, _CONTEXT)


def _sorted(table: pa.Table, length: int, opens: bool, closes: bool) -> Iterator[pa.RecordBatch]:
    """Spans to remove (null ``window``) of contexts in order of (gram, place, lo); of the first stretch if it
    ``opens`` and the last if it ``closes``, also the runs that were first here, by digest."""
    gram = table.column("gram").combine_chunks().dictionary_encode().indices.to_numpy()
    group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
    place, lo, hi, lead = (table.column(c).to_numpy() for c in ("place", "lo", "hi", "lead"))
    data, offsets = _bytes(table.column("body").combine_chunks())
    base, size = offsets[:-1], hi - lo
    cls = (group * (2 * length) + lead) * (2 * length) + size
    rank = multikey(data, base, size, cls)
    order = np.lexsort((np.arange(len(rank)), rank))
    later = np.zeros(len(rank), bool)
    later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    spans = [(place[later], lo[later], hi[later])]
    crossing = np.zeros(int(group[-1]) + 1, bool)
    crossing[0] |= opens
    crossing[-1] |= closes
    # the runs of contexts that differ, where a stretch has several or may have
    several = np.bincount(group[~later], minlength=len(crossing)) > 1
    rows = np.flatnonzero(~later & (several | crossing)[group])
    n = size[rows] - length + 1
    row = np.repeat(rows, n)
    within = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(row) else np.zeros(0, np.int64)
    start = base[row] + within
    rank = multikey(data, start, np.full(len(row), length), group[row] * (2 * length) + lead[row] - within + length)
    order = np.lexsort((row, rank))
    again = np.zeros(len(row), bool)
    again[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    hit = np.flatnonzero(again)
    if len(hit):
        edge = np.flatnonzero(np.r_[True, (row[hit[1:]] != row[hit[:-1]]) | (within[hit[1:]] != within[hit[:-1]] + 1)])
        end = hit[np.r_[edge[1:], len(hit)] - 1]
        begin = hit[edge]
        spans.append((place[row[begin]], lo[row[begin]] + within[begin], lo[row[begin]] + within[end] + length))
    columns = [np.concatenate([s[k] for s in spans]) for k in range(3)]
    names = ["place", "lo", "hi", "window"]
    yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.nulls(len(columns[0]), pa.binary())], names=names)
    first = np.flatnonzero(~again & crossing[group[row]])
    raw = data.tobytes()
    for part in range(0, len(first), 1 << 16):
        some = first[part : part + (1 << 16)]
        digests = [hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in start[some].tolist()]
        at = lo[row[some]] + within[some]
        yield pa.RecordBatch.from_arrays([pa.array(place[row[some]]), pa.array(at), pa.array(at + length), pa.array(digests, pa.binary())], names=names)


def _buckets(contexts: DataFrame, length: int, held_bytes: int) -> DataFrame:
    """Spans and boundary runs (place, lo, hi, window) of all contexts, dealt by range and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, opens = 0, True

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                held.append(part)
                size += part.nbytes
                if size < held_bytes:
                    continue
                table = pa.Table.from_batches(held)
                gram = table.column("gram").combine_chunks()
                other = np.flatnonzero(gram.dictionary_encode().indices.to_numpy() != gram.dictionary_encode().indices.to_numpy()[-1])
                # up to the last stretch, or all of it where one stretch is more than is held
                cut = int(other[-1]) + 1 if len(other) else table.num_rows
                yield from _sorted(table.slice(0, cut), length, opens, not len(other))
                opens = not len(other)
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from _sorted(pa.Table.from_batches(held), length, opens, True)

    keys = ("gram", "place", "lo")
    dealt = contexts.withColumn("gram", F.substring("body", F.col("lead") + 1, F.lit(gram_of(length)))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "place long, lo long, hi long, window binary")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>, text binary"


def _cut(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, owned, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "owned", "spans")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    spans = []
                elif not owned:
                    spans = [{"lo": 0, "hi": len(raw)}]
                merged: list[list[int]] = []
                for s in spans or []:
                    if merged and s["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["hi"])
                    else:
                        merged.append([s["lo"], s["hi"]])
                edges = [0, *[e for m in merged for e in m], len(raw)]
                kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in merged], kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    return rows.select("doc_id", "text", "owned", "spans").mapInArrow(run, _OUT)


def deduplicate(docs: DataFrame, length: int = LENGTH, held_bytes: int = HELD, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text) of (doc_id, text): the spans of bytes that
    are removed, end exclusive, and the bytes that stay (null without ``with_text``)."""
    spark = docs.sparkSession
    textkit.bound_batches(spark)
    folder = workspace(spark, "substrings")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    texts = materialize(texts, folder, "texts")
    long = texts.filter(F.octet_length("text") >= length)
    first = F.min(F.struct("doc_id", "uid")).alias("first")
    owners = long.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "doc_id", "uid").groupBy("sha").agg(first).select("sha", "first.*")
    owners = materialize(numbered(owners, ["doc_id", "sha"], folder, "owners").select("uid", F.col("n").cast("long").alias("place")), folder, "places")
    repeated = materialize(_repeated(long, length), folder, "repeated")
    hits = _places(long, length).join(repeated, "hash", "left_semi").join(owners, "uid")
    marks = materialize(hits.groupBy("uid", "place").agg(F.collect_list("run").alias("runs")), folder, "marks")
    contexts = materialize(_contexts(long.select("uid", "text").join(marks, "uid").drop("uid"), length), folder, "contexts")
    found = materialize(_buckets(contexts.filter("body is not null"), length, held_bytes), folder, "found")
    across = Window.partitionBy("window").orderBy("place", "lo")
    crossed = found.filter("window is not null").withColumn("nth", F.row_number().over(across)).filter("nth > 1")
    spans = contexts.filter("body is null").select("place", "lo", "hi").unionByName(found.filter("window is null").drop("window")).unionByName(crossed.select("place", "lo", "hi"))
    listed = spans.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    owned = owners.join(listed, "place", "left").select("uid", F.lit(True).alias("owned"), "spans")
    return _cut(texts.join(owned, "uid", "left").withColumn("owned", F.coalesce("owned", F.lit(False))), length, with_text)
