"""Sinks: graph tables, caches, statistics, results, traces and exports."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of a graph, written over the former build."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def cache_file(folder: str, path: str) -> str:
    """Where the extractions of a document are kept, by its absolute path."""
    whole = path if "://" in path else os.path.abspath(path)
    return f"{folder.rstrip('/')}/extraction_{hashlib.md5(whole.encode()).hexdigest()[:10]}.json"


def write_cache(extractions: DataFrame, folder: str, path: str) -> None:
    extractions.write.mode("overwrite").json(cache_file(folder, path))


def write_json(df: DataFrame, path: str) -> None:
    """Statistics (one row) or results (nested rows)."""
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """A trace or hierarchy, one line a row, in the rows' order."""
    lines.select(column).write.mode("overwrite").text(path)
