"""Replies of a model that outlive tasks, stages and runs.

A reply table lies in a folder that all executors share, keyed by the hash of the prompt. Only prompts that it has
no answer to are asked, each once however often it repeats; a task writes every reply as soon as it has it, into a file
named by the hash, and asks only where there is none. So what a lost task, or a run that was broken off, had been
told is read by the next one. At the end of a stage the files become rows of the table. What failed is a row too: a prompt
that is too large counts as answered, without a reply; others are asked again by the next run.

Files are written through Arrow's file systems: local and mounted folders, s3, gs, hdfs where its library is
installed. There is one small file a call of the stage at hand, and calls are few a minute.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.config import DEFAULT, Config
from loam.operators import client as C
from loam.store import materialize, remove, workspace

Client = Callable[[str], str]
SCHEMA = "key string, reply string, kind string, message string, asked_at double"
#: Kinds of failures after which a task asks no more: the next prompt would fail as well.
ENDING = ("quota", "fatal")


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = folder.partition("://")
    if not rest:
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else folder)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the reply table: (key, reply, kind, message, asked_at)."""
    path = f"{folder}/table"
    return spark.read.schema(SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SCHEMA)


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """(key, reply) of prompts that need not be asked again; a null reply: too large."""
    return table(spark, folder).filter("kind is null or kind = 'tokens'").groupBy("key").agg(F.max("reply").alias("reply"))


def _recent(spark: SparkSession, folder: str, config: Config) -> list[float]:
    """When the last calls were made that still count for this minute; no more than a minute may hold."""
    rows = table(spark, folder).filter(F.col("asked_at") > time.time() - C.SPAN).select("asked_at").orderBy(F.desc("asked_at")).limit(config.calls_per_minute)
    return [r.asked_at for r in rows.collect()]


def ask(rows: DataFrame, client: Client, folder: str, prompt: str = "prompt", tasks: int = 1, config: Config = DEFAULT) -> DataFrame:
    """``rows`` with a ``reply`` to each ``prompt``: null where it is too large (or null itself), ``""`` where the service could not
    be reached to the last. A spent quota, a fatal or unknown error raises once all tasks have ended and what they were
    told is kept.

    ``tasks`` of them share the rate limit, no more than calls a minute; calls of the minute before count, and
    a task that is run again waits a whole span first.
    """
    spark = rows.sparkSession
    tasks = max(1, min(tasks, config.calls_per_minute))
    own = workspace(spark, "asked")
    keyed = materialize(rows.withColumn("loam_key", F.sha2(F.col(prompt), 256)), own, "rows")
    known = answered(spark, folder)
    wanted = keyed.filter(F.col(prompt).isNotNull()).select(F.col("loam_key").alias("key"), F.col(prompt).alias("loam_prompt")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    wanted = materialize(wanted, own, "wanted")
    if not wanted.isEmpty():
        recent, log = _recent(spark, folder, config), f"{folder}/log"

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = TaskContext.get()
            used = recent[at.partitionId() % tasks :: tasks] if at.attemptNumber() == 0 else [time.time()] * config.calls_per_minute
            limiter = C.RateLimiter(config.calls_per_minute, tasks, used=used)
            files, base = _files(log)
            files.create_dir(base, recursive=True)
            ended = False
            for part in parts:
                out = []
                for key, text in zip(part["key"], part["loam_prompt"], strict=True):
                    path = f"{base}/{key}.json"
                    if files.get_file_info(path).type != fs.FileType.NotFound:
                        with files.open_input_stream(path) as f:
                            kept = json.loads(f.read().decode())
                        if kept["kind"] in (None, "tokens"):
                            out.append(kept)
                            continue
                    if ended:
                        continue
                    reply, kind, said = C.answer(client, text, limiter)
                    kept = {"key": key, "reply": reply, "kind": kind, "message": said, "asked_at": time.time()}
                    with files.open_output_stream(f"{path}.part") as f:
                        f.write(json.dumps(kept).encode())
                    files.move(f"{path}.part", path)  # whole or not there
                    out.append(kept)
                    ended |= kind in ENDING
                yield pd.DataFrame(out, columns=["key", "reply", "kind", "message", "asked_at"])

        wanted.repartition(tasks).mapInPandas(run, SCHEMA).write.mode("append").parquet(f"{folder}/table")
        remove(spark, log)
        failed = table(spark, folder).join(wanted.select("key"), "key", "left_semi").join(answered(spark, folder).select("key"), "key", "left_anti")
        worst = failed.filter(F.col("kind").isin(*ENDING, "other")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("message")).orderBy("kind").collect()
        if worst:
            raise C.RAISED[worst[0].kind](f"{sum(r.n for r in worst)} prompts failed ({', '.join(r.kind for r in worst)}): {worst[0].message}; answered ones are kept in {folder}")
    # read when all is told: null stands for too large, no row for what could not be reached
    told = answered(spark, folder).select(F.col("key").alias("loam_key"), "reply", F.lit(True).alias("loam_told"))
    out = keyed.join(told, "loam_key", "left").withColumn("reply", F.when(F.col("loam_told").isNull() & F.col(prompt).isNotNull(), "").otherwise(F.col("reply")))
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType())])
    return materialize(out.select(*[f.name for f in schema]), own, "replies")
