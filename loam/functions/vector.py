"""Vectors: cosine, normalising, and a hashed bag-of-words embedding in plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64
EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.transform(F.arrays_zip(a.alias("v"), F.array_repeat(length, F.size(a)).alias("n")), lambda x: x.v.cast("double") / (x.n + EPSILON))


def rounded(value: Column, digits: int) -> Column:
    """``value`` (double) to ``digits`` decimal places as C and SQL engines round: scaled first, halves of the product away
    from zero, and zeros keep their sign. Spark's own rounds the shortest decimal form, and differs where that is nearly a half."""
    scale = float(10**digits)
    size = F.abs(value * scale)
    whole = F.floor(size).cast("double")
    # from 2^52 on there are no fractions
    near = F.signum(value) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(size < float(1 << 52), near).otherwise(value)


def word_bucket(word: Column, dim: int = DIM) -> Column:
    """A bucket from a word's letters and length, the same in any SQL engine."""
    letter = lambda k: F.ascii(F.substring(word, k, 1))
    return (letter(1) * 961 + letter(2) * 31 + letter(3) * 17 + F.ascii(F.substring(word, -1, 1)) * 3 + F.length(word) * 7) % dim


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def embed(df: DataFrame, key: str, text: str, out: str = "embedding") -> DataFrame:
    """``df`` with word counts over ``DIM`` buckets, made inside each row: no shuffle, no Python.

    Each word becomes one character of a string; a count is what replacing that character takes off.
    """
    marks = F.array_join(F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.char(word_bucket(w) + 48)), "")
    counts = F.array([(F.length("loam_marks") - F.length(F.replace(F.col("loam_marks"), F.lit(chr(48 + b)), F.lit("")))).cast("double") for b in range(DIM)])
    return df.withColumn("loam_marks", marks).withColumn(out, counts).drop("loam_marks")


def unrolled_dot(a: str, b: str) -> Column:
    """The dot product of two columns. Vectors of ``DIM`` entries are spelt out, so that it is
    generated code and not a loop of interpreted lambdas, in the order of ``dot``; others take the
    loop. Vectors of two lengths have none (null)."""
    spelt = reduce(lambda x, y: x + y, (F.get(F.col(a), F.lit(k)) * F.get(F.col(b), F.lit(k)) for k in range(DIM)))
    n, m = F.size(a), F.size(b)
    return F.when((n == DIM) & (m == DIM), spelt).when(n == m, dot(F.col(a), F.col(b)))


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    return df.withColumn(out, cosine(F.col(a), F.col(b)))


def model_embed(encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> Callable[..., DataFrame]:
    """A function like ``embed`` from a model's: texts to a matrix of one row a text, of any width.
    It runs on Arrow batches, ``batch`` texts at a time; null texts are empty."""

    def run_embed(df: DataFrame, key: str, text: str, out: str = "embedding") -> DataFrame:
        place = df.columns.index(text)
        schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for lo in range(0, rows.num_rows, batch):
                    part = rows.slice(lo, batch)
                    x = np.asarray(encode([t or "" for t in part.column(place).to_pylist()]), np.float64)
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0))
                    vectors = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                    kept = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name != out]
                    yield pa.RecordBatch.from_arrays([*kept, vectors], names=[f.name for f in schema])

        return df.mapInArrow(run, schema)

    return run_embed
