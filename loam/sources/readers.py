"""Scans: text files, directories, binary documents with a pluggable extractor, questions, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.sources.sinks import cache_file
from loam.store import numbered, workspace

Extractor = Callable[[bytes], list[str]]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of text files: UTF-8 with bad bytes replaced, any newline as \\n."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), T.normalise_newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def read_documents(spark: SparkSession, path: str, extractor: Extractor) -> DataFrame:
    """(file_name, text) of binary documents: the extractor's pages, joined without a separator."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"file_name": part.file_name, "text": ["".join(extractor(bytes(c))) for c in part.content]})

    return files.mapInPandas(run, "file_name string, text string")


def read_directory(spark: SparkSession, path: str, extractor: Extractor | None = None) -> DataFrame:
    """(file_name, text) of a directory's .txt (and, with an extractor, .pdf) files, any case, not recursive."""
    out = read_text(spark, f"{path.rstrip('/')}/*.[tT][xX][tT]") if _any(spark, path, "txt") else None
    if extractor is not None and _any(spark, path, "pdf"):
        more = read_documents(spark, f"{path.rstrip('/')}/*.[pP][dD][fF]", extractor)
        out = more if out is None else out.unionByName(more)
    if out is None:
        raise FileNotFoundError(f"no .txt or .pdf files in {path}")
    return out


def _any(spark: SparkSession, path: str, extension: str) -> bool:
    pattern = "".join(f"[{c}{c.upper()}]" for c in extension)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.{pattern}")
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_input(spark: SparkSession, path: str, extractor: Extractor | None = None) -> tuple[DataFrame, str]:
    """(files, document name): a directory, a .txt file, or anything else through the extractor."""
    name = path.rstrip("/").rpartition("/")[2]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return read_directory(spark, path, extractor), name or "multi_doc"
    if path.lower().endswith(".txt"):
        return read_text(spark, path), name
    if extractor is None:
        raise ValueError(f"an extractor is needed for {path}")
    return read_documents(spark, path, extractor), name


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, query, ground_truth) from CSV with a header, or from a JSON list."""
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=None)
    else:
        rows = spark.read.json(path, multiLine=True)
    missing = {"query", "ground_truth"} - set(rows.columns)
    if missing:
        raise ValueError(f"questions need {sorted(missing)}")
    rows = numbered(rows.withColumn("loam_place", F.monotonically_increasing_id()), ["loam_place"], workspace(spark, "questions")).withColumn("loam_place", F.col("n") + 1)
    own = F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
    kind = F.col("category") if "category" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(own, F.concat(F.lit("q_"), F.col("loam_place"))).alias("id"), F.coalesce(kind, F.lit("general")).alias("category"), "query", "ground_truth")


#: Of a cached extraction. Read with it, as JSON leaves out what is null.
EXTRACTION = (
    "doc_id long, idx long, entities array<struct<name:string,type:string,description:string>>, "
    "relationships array<struct<source:string,target:string,type:string,evidence:string>>"
)


def read_cache(spark: SparkSession, folder: str, path: str) -> DataFrame | None:
    """Cached extractions of a document, or None."""
    at = cache_file(folder, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(EXTRACTION).json(at)
