"""How the work of a streamed batch is dealt, and names of one plain word."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import extract
from loam.plans import queries as plans
from loam.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def test_a_batch_of_one_file_is_dealt_to_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    docs = [(k, "Alphaone meets " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=100_000)) + " Betatwo", "s") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    ingest.ingest(spark, str(tmp_path / "in"), "doc_id long, text string, source string", target, str(tmp_path / "cp"), files=1).awaitTermination()
    assert len(list(Path(f"{target}/chunk/batch=0").glob("*.parquet"))) > 1
    key = lambda df: sorted(map(tuple, df.select("chunk_id", F.md5("text")).collect()))
    assert key(spark.read.parquet(f"{target}/chunk/batch=0")) == key(extract.chunk(spark.read.parquet(str(tmp_path / "in"))))


def test_the_streamed_files_grow_with_the_table_and_the_batches_do_not(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        store = Path(plans._grown(spark, FOLDER).removeprefix("file://"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(list((store.parent / "in").glob("*.parquet"))) > 4
    assert 2 <= len(list((store / "document").glob("batch=*"))) <= 4
    assert spark.read.parquet(f"file://{store}/document").count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_plain_words_have_the_name_and_key_of_the_long_way(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("aBcZtheTHE09 \n\r\t(). ßİıſKéǅ\u0085\x1c_-", k=rng.randint(0, 7))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "The", "the x", "abc\n", "Abc", "A1", "1a", "straße"]], "s string")
    s = F.col("s")
    wrong = rows.filter(~X._canonical(s).eqNullSafe(X.canonical_key(s)) | ~X.title(X.strip(s)).eqNullSafe(X.entity_name(s)))
    assert wrong.collect() == [] and rows.filter(F.regexp_like(s, F.lit(r"^[A-Za-z0-9]+\z"))).count() > 100
