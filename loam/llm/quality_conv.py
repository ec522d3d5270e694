"""Quality scores from a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Filters of ``WIDTH``
bytes (a learned vector for each filter, place and byte value) slide over each chunk; each
filter's largest response in a chunk is kept, passed through a ReLU, and the chunks' mean and
largest values go, with the log of the length, into one logistic unit: the probability.

Training: Adam on at most ``SAMPLE`` labelled documents of some ``LEARNED`` bytes in all, the
smallest by hash of doc_id, seeded, so that refits agree. Defined results: null and empty text
have no chunk and score the bias of the length feature alone; with no labels, or one class
only, the score is that class's rate (0.5 without labels). Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm import sampling, textkit

SAMPLE = 1500
#: Bytes of them, whatever the length of each.
LEARNED = 12_000_000
FILTERS = 12
WIDTH = 5
CHUNK = 512
OVERLAP = 64
EPOCHS = 14
BATCH = 32
THRESHOLD = 0.7


def chunk_bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of the chunks that cover each document; an empty one has none."""
    length = np.diff(offsets)
    step = CHUNK - OVERLAP
    count = np.where(length > 0, np.maximum(1, -(-(length - OVERLAP) // step)), 0)
    doc = np.repeat(np.arange(len(length)), count)
    index = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[doc] + index * step
    return begin, np.minimum(begin + CHUNK, offsets[doc + 1]), doc


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS + 1
    offset: float
    constant: float | None = None

    def pooled(self, data: np.ndarray, offsets: np.ndarray, where: bool = False):
        """Per chunk the largest responses (and their places), and the chunks' documents.

        Each document is followed by places that no filter weighs, so its responses are its own
        whatever stands beside it. Blocks of chunks are worked on in turn, to stay in cache.
        """
        begin, end, doc = chunk_bounds(offsets)
        f = self.filters.shape[2]
        if not len(begin):
            none = np.zeros((0, f), np.float32), doc
            return (*none, np.zeros((0, f), np.int64)) if where else none
        table = np.concatenate([self.filters, np.zeros((WIDTH, 1, f), np.float32)], 1)
        shift = (WIDTH - 1) * np.arange(len(offsets) - 1)
        padded = np.full(len(data) + (WIDTH - 1) * (len(offsets) - 1), 256, np.uint16)
        padded[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
        first, last = begin + shift[doc], end + shift[doc]
        pooled, places = [], []
        for lo in range(0, len(begin), 64):
            b, e = first[lo : lo + 64], last[lo : lo + 64]
            r = table[0][padded[b[0] : e[-1]]]
            for k in range(1, WIDTH):
                r += table[k][padded[b[0] + k : e[-1] + k]]
            cut = np.stack([b, e], 1).ravel() - b[0]
            pooled.append(np.maximum.reduceat(r, cut[:-1], axis=0)[::2])
            if where:
                places.append(np.stack([r[x:y].argmax(0) + x + b[0] for x, y in zip(cut[::2], cut[1::2], strict=True)]) - shift[doc[lo : lo + 64], None])
        top = np.concatenate(pooled)
        return (top, doc, np.concatenate(places)) if where else (top, doc)

    def features(self, top: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, f = len(offsets) - 1, top.shape[1]
        act = np.maximum(top + self.bias, 0)
        count = np.bincount(doc, minlength=n)
        mean, most = np.zeros((n, f)), np.zeros((n, f))
        if len(doc):
            has = np.flatnonzero(count)
            first = np.searchsorted(doc, has)
            mean[has] = np.add.reduceat(act, first, axis=0) / count[has, None]
            most[has] = np.maximum.reduceat(act, first, axis=0)
        return np.concatenate([mean, most, np.log1p(np.diff(offsets))[:, None] / 10], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        top, doc = self.pooled(data, offsets)
        z = self.features(top, doc, offsets) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Learn from (text, quality) rows."""
    rng = np.random.default_rng(seed)
    f = FILTERS
    model = Model(
        rng.normal(0, 0.3, (WIDTH, 256, f)).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.3, 2 * f + 1), 0.0
    )
    y_all = np.array([y for _, y in rows], float)
    if len(rows) == 0 or y_all.min() == y_all.max():
        model.constant = float(y_all.mean()) if len(rows) else 0.5
        return model
    texts = [t.encode() for t, _ in rows]
    weight_all = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean())) ** 0.5  # the rarer class counts more
    parts = [model.filters, model.bias, model.weights]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts] + [[0.0, 0.0]]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in take), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in take])])
            top, doc, place = model.pooled(data, offsets, where=True)
            x = model.features(top, doc, offsets)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.offset, -30, 30)))
            err = (p - y_all[take]) * weight_all[take] / len(take)
            g_weights = x.T @ err + 1e-4 * model.weights
            act = np.maximum(top + model.bias, 0)
            count = np.bincount(doc, minlength=len(take))[doc][:, None]
            largest = act == x[doc, f : 2 * f]
            g_act = err[doc][:, None] * (model.weights[:f] / count + model.weights[f : 2 * f] * largest)
            g_act *= act > 0
            g_filters = np.zeros_like(model.filters)
            for k in range(WIDTH):
                at = place + k
                ok = at < offsets[doc + 1][:, None]
                np.add.at(g_filters[k], (data[np.minimum(at, len(data) - 1)], np.arange(f)[None, :]), g_act * ok)
            step += 1
            for part, grad, m in zip([*parts, None], [g_filters, g_act.sum(0), g_weights, err.sum()], moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * np.square(grad)
                move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                if part is None:
                    model.offset -= float(move)
                else:
                    part -= move.astype(part.dtype)
    return model


def fit_from(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from documents (doc_id, text) and labels (doc_id, quality), all of which may be used."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = F.broadcast(sampling.smallest(known, ["doc_id"], 2 * sample))  # twice, as some have no text that fits
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").filter("text is not null")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("loam_hash", F.xxhash64("doc_id"))
    rows = rows.orderBy("loam_hash", "doc_id").limit(sample)
    before = F.sum(F.octet_length("text")).over(Window.orderBy("loam_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("loam_before", F.coalesce(before, F.lit(0))).filter(F.col("loam_before") < LEARNED)
    return fit(sorted((r.text, r.quality) for r in rows.collect()))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with score and predicted."""
    df = df.drop(*(c for c in ("score", "predicted") if c != text))  # the results replace columns of their names
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    textkit.bound_batches(spark)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = textkit.string_bytes(batch.column(batch.schema.get_field_index(text)))
            parts = [own.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in textkit.slices(offsets)]
            score = np.concatenate([np.zeros(0), *parts])
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text]
            columns += [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)
