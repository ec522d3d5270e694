"""Language identification: script ranges, per-word scores, and Viterbi over words.

A word is a run of letters. The scripts of its characters narrow its candidates to the languages that
use one of them in the training texts (all, where none does), and only those can label it; each
scores the word with hashed byte n-grams. Viterbi with a penalty for changing language labels every word; equal neighbours make
spans, and the language that labels most letters is the document's.

The recursion is cut into blocks of ``BLOCK`` words. Max-plus matrices of all blocks of many
documents are made side by side, chained per document, and traced back, so a very long text
costs no Python step per word and the path is the exact optimum. From ``FEW`` languages on, whose matrices would
be large, a document goes word by word and is traced back from states kept every ``BLOCK`` words.

Learning takes at most ``PER_LANGUAGE`` labelled documents of each language, the smallest by hash of doc_id
and text (repeated rows count once), whole and whatever their length, until they hold ``LEARNED`` characters. Defined results: null text, or text
with no letter, is ``und`` with score 0 and no spans; with nothing learned all is ``und``;
ties go to the smaller language name. The score is the share of letters under the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm import sampling, textkit

PER_LANGUAGE = 400
LEARNED = 2_000_000
SWITCH = 12.0
BITS = 17
GRAMS = (2, 3, 5)
BLOCK = 64
FEW = 32
#: Score of a language that is no candidate of a word: no path is worth it, as changing the language costs less.
BARRED = np.float32(-1e9)
#: A language uses a script that at least this share of its letters is in.
SCRIPT_SHARE = 0.02

# First code points of the ranges of scripts, and the script of each range.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1400, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "None"), (0x2C00, "Other"), (0x2E80, "Han"),
    (0x3000, "None"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Other"), (0xFF00, "None"), (0xFF21, "Latin"), (0xFF5B, "None"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "None"),
    (0x10000, "Other"), (0x1AFF0, "Kana"), (0x1B170, "Other"), (0x1F000, "None"), (0x20000, "Han"), (0x33480, "None"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(1)
def _point_bits() -> np.ndarray:
    """The bit of the script of every code point; a letter outside all ranges has that of ``Other``."""
    starts = np.array([start for start, _ in SCRIPT_RANGES])
    bits = np.array([0, *(0 if name == "None" else 1 << SCRIPTS.index(name) for _, name in SCRIPT_RANGES)], np.int32)
    out = bits[np.searchsorted(starts, np.arange(0x110000), "right")]
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out[:0x300][~letter[:0x300]] = 0
    out[letter & (out == 0)] = 1 << SCRIPTS.index("Other")
    return out


def script_bits(data: np.ndarray) -> np.ndarray:
    """For every byte the bit of its character's script; 0 where it is no letter."""
    latin = 1 << SCRIPTS.index("Latin")
    out = np.where(_ASCII_LETTER[data], latin, 0)
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (padded[high + k] for k in range(4))
        n = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        point = np.where(n == 2, (b0 & 31) << 6 | b1 & 63, np.where(n == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        bit = _point_bits()[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            at = high[n > k] + k
            ok = at < len(data)
            out[at[ok]] = bit[n > k][ok]
    return out


def gram_slots(data: np.ndarray, n: int) -> np.ndarray:
    """A table slot for the ``n`` bytes that begin at every place; beyond the end stand blanks."""
    lower = np.concatenate([_LOWER[data], np.full(n, 32, np.uint8)]).astype(np.uint64)
    value = np.full(len(data), n, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | lower[k : k + len(data)]
    value *= np.uint64(0x9E3779B97F4A7C15)
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scripts: np.ndarray  # the bits of each language's scripts
    table: np.ndarray  # slots by languages: log-probabilities, centred

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> Model:
        """From (text, language) rows."""
        languages = sorted({lang for text, lang in rows if lang is not None and text})
        table, scripts = np.zeros((len(GRAMS) << BITS, max(1, len(languages)))), []
        for k, language in enumerate(languages):
            data = np.frombuffer(" ".join(t for t, x in rows if x == language and t).encode(), np.uint8)
            bits = script_bits(data)
            letters = bits > 0
            share = [((bits >> s) & 1).sum() / max(1, letters.sum()) for s in range(len(SCRIPTS))]
            scripts.append(sum(1 << s for s, x in enumerate(share) if x >= SCRIPT_SHARE))
            for g, n in enumerate(GRAMS):
                table[g << BITS : (g + 1) << BITS, k] = np.bincount(gram_slots(data, n)[letters], minlength=1 << BITS)
        for g in range(len(GRAMS)):
            part = table[g << BITS : (g + 1) << BITS]
            part += 0.1
            part /= part.sum(0)
        table = np.log(table)
        return cls(languages, np.array(scripts, np.int64), (table - table.mean(1, keepdims=True)).astype(np.float32))

    def word_scores(self, data: np.ndarray, bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words by languages."""
        total = None
        for g, n in enumerate(GRAMS):
            part = self.table[(g << BITS) + gram_slots(data, n)]
            total = part if total is None else np.add(total, part, out=total)
        total[bits == 0] = 0
        scores = np.add.reduceat(total, starts, axis=0)
        used = np.bitwise_or.reduceat(bits, starts)
        fits = (used[:, None] & self.scripts[None, :]) > 0
        narrowed = fits.any(1)
        scores[narrowed[:, None] & ~fits] = BARRED
        return scores


def _stepwise(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of one document: forward with what every ``BLOCK``-th word begins from kept, then back block by block."""
    n, states = scores.shape
    own = np.arange(states)

    def forward(value: np.ndarray, part: np.ndarray, came: np.ndarray | None) -> np.ndarray:
        for t, s in enumerate(part):
            best = int(value.argmax())
            other = value[best] - penalty
            if came is not None:
                came[t] = np.where(value >= other, own, best)
            value = np.maximum(value, other) + s
        return value

    value, kept = np.zeros(states), []
    for lo in range(0, n, BLOCK):
        kept.append(value)
        value = forward(value, scores[lo : lo + BLOCK], None)
    path, state = np.zeros(n, np.int64), int(value.argmax())
    for k in range(len(kept) - 1, -1, -1):
        part = scores[k * BLOCK : (k + 1) * BLOCK]
        came = np.zeros(part.shape, np.int16)
        forward(kept[k], part, came)
        for t in range(len(part) - 1, -1, -1):
            path[k * BLOCK + t] = state
            state = int(came[t, state])
    return path


def best_path(scores: np.ndarray, doc: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The state of every word on the best path of its document; ``doc`` is sorted."""
    n, states = scores.shape
    if n == 0 or states == 1:
        return np.zeros(n, np.int64)
    if states >= FEW:
        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), n)
        return np.concatenate([_stepwise(scores[a:b], penalty) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    blocks = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(first)), blocks)  # the document of each block
    index = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[chain] + index * BLOCK
    size = np.minimum(BLOCK, first[chain] + length[chain] - begin)
    change = np.full((states, states), -penalty, scores.dtype)
    np.fill_diagonal(change, 0)

    def word(t: int) -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(size > t)
        return live, scores[begin[live] + t]

    # max-plus matrix of each block: from the state before it to its last state
    matrix = np.broadcast_to(change, (len(chain), states, states)).copy()
    for t in range(int(size.max())):
        live, s = word(t)
        m = matrix[live]
        if t:
            m = np.maximum(m, m.max(2, keepdims=True) - penalty)
        matrix[live] = m + s[:, None, :]
    # over the blocks of each document, all documents side by side
    head = np.flatnonzero(index == 0)
    value = np.zeros((len(first), states), scores.dtype)
    back = np.zeros((len(chain), states), np.int64)
    order = np.argsort(-blocks, kind="stable")
    for b in range(int(blocks.max())):
        live = order[: int(np.count_nonzero(blocks > b))]
        reach = value[live][:, :, None] + matrix[head[live] + b]
        back[head[live] + b] = reach.argmax(1)
        value[live] = reach.max(1)
    last, before = np.zeros(len(chain), np.int64), np.zeros(len(chain), np.int64)
    state = value.argmax(1)
    for b in range(int(blocks.max()) - 1, -1, -1):
        live = order[: int(np.count_nonzero(blocks > b))]
        at = head[live] + b
        last[at] = state[live]
        state[live] = before[at] = back[at, state[live]]
    # inside the blocks, between the known states at both ends
    v = change[before].copy()
    came = np.zeros((int(size.max()), len(chain), states), np.int16)
    for t in range(int(size.max())):
        live, s = word(t)
        u = v[live]
        if t:
            best = u.argmax(1)
            other = u[np.arange(len(live)), best][:, None] - penalty
            came[t, live] = np.where(u >= other, np.arange(states), best[:, None])
            u = np.maximum(u, other)
        v[live] = u + s
    path = np.zeros(n, np.int64)
    state = last.copy()
    for t in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(size > t)
        path[begin[live] + t] = state[live]
        if t:
            state[live] = came[t, live, state[live]]
    return path


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def label(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans (code points, end exclusive) of each document of a slice."""
    n = len(offsets) - 1
    pred, score, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    bits = script_bits(data)
    starts, ends, doc = textkit.word_bounds(data, offsets, bits > 0)
    if not len(starts) or not model.languages:
        return pred, score, spans
    path = best_path(model.word_scores(data, bits, starts, ends), doc)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = np.bincount(doc * len(model.languages) + path, weights=point[ends] - point[starts], minlength=n * len(model.languages)).reshape(n, -1)
    best = letters.argmax(1)
    share = letters.max(1) / np.maximum(letters.sum(1), 1)
    edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    until = np.append(edge[1:], len(doc)) - 1
    shift = point[offsets[doc[edge]]]
    for d, p, b, e in zip(doc[edge].tolist(), path[edge].tolist(), (point[starts[edge]] - shift).tolist(), (point[ends[until]] - shift).tolist(), strict=True):
        spans[d].append({"lang": model.languages[p], "begin": b, "end": e})
    for d in np.unique(doc).tolist():
        text = data[offsets[d] : offsets[d + 1]]
        if _ASCII_LETTER[text].any() or any(map(str.isalpha, text.tobytes().decode(errors="replace"))):
            pred[d], score[d] = model.languages[best[d]], share[d]
        else:
            spans[d] = []
    return pred, score, spans


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, learned: int = LEARNED) -> Model:
    """Learn from documents (doc_id, text, lang), all of which may be used."""
    rows = documents.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    few = sampling.smallest(rows, ["doc_id", "text"], per_language, "lang").withColumn("loam_hash", F.xxhash64("doc_id", "text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("loam_hash", "text").rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("loam_before", F.coalesce(before, F.lit(0))).filter(F.col("loam_before") < learned)
    return Model.fit(sorted((r.text, r.lang) for r in few.select("text", "lang").collect()))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with lang_pred, score and spans."""
    df = df.drop(*(c for c in ("lang_pred", "score", "spans") if c != text))  # the results replace columns of their names
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    textkit.bound_batches(spark)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    # of the scores: words by languages; of the matrices: languages squared for each block
    most = textkit.SLICE_BYTES * 16 // max(16, len(model.languages) ** (2 if len(model.languages) < FEW else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        spans_type = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, offsets = textkit.string_bytes(batch.column(batch.schema.get_field_index(text)))
            pred, score, spans = [], [], []
            for lo, hi in textkit.slices(offsets, most):
                p, s, x = label(own, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                pred += p
                score.append(s)
                spans += x
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text]
            columns += [pa.array(pred, pa.string()), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)
