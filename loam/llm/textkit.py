"""Numpy kernels over the UTF-8 bytes of Arrow string columns: slices, words, hashes, shingles.

Everything works on the concatenated bytes of a slice of documents, so no Python code runs
per word. A slice holds about ``SLICE_BYTES`` of text, more only where one document does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch, where the session says nothing else: Spark counts rows alone, and ten
#: thousand long texts are more than a task should hold.
BATCH_ROWS = 512
#: White space of the contract: blank and the five control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
#: Words of more bytes get a cryptographic digest; for shorter ones no two strings that cancel
#: out modulo 2^64 whatever the multiplier (Thue and Morse) fit.
LONG_WORD = 512


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches for this session, unless it sets a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets into them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes each, or of one document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the document of each word.

    ``inside`` flags the bytes that belong to words; by default all but white space do.
    """
    ink = ~IS_SPACE[data] if inside is None else inside
    n = len(ink)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; their size does not depend on any text."""
    tables = []
    for p in (_P, _P_INVERSE):
        t = np.full(SLICE_BYTES + LONG_WORD + 1, p, np.uint64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    return tables[0], tables[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, by differences of a running polynomial that
    starts anew every ``SLICE_BYTES``."""
    power, inverse = _power_tables()
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + SLICE_BYTES, "left"))
        first = starts[lo:hi] - base
        last = np.minimum(ends[lo:hi] - base, first + LONG_WORD)
        part = data[base : base + int(last.max())].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        value = (sums[last] - sums[first]) * inverse[first]
        out[lo:hi] = mix64(value ^ ((last - first).astype(np.uint64) << np.uint64(48)))
        lo = hi
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their document; a shorter text has one, of all its words."""
    m = np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(doc, minlength=n_docs)
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= n:
        value = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            value = value * m + hashes[k : len(hashes) - n + 1 + k]
        whole = doc[: len(value)] == doc[n - 1 :]
        out, where = mix64(value[whole]), doc[: len(value)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.searchsorted(doc, short)
        value = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            value[has] = value[has] * m + hashes[begin[has] + k]
        out = np.concatenate([out, mix64(value ^ counts[short].astype(np.uint64))])
        where = np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where
