"""Chunks, and the entities and relationships that an extractor finds in them.

The offline extractor is deterministic: mentions are capitalised words of six letters or more,
relationships join neighbouring mentions of a chunk; ``models`` has one that asks a model. Every row carries its place
(doc_id, idx, pos), by which "first" is defined everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.config import DEFAULT
from loam.functions import text as X
from loam.store import materialize, placed

MENTION = "[A-Z][a-z]{5,}"
# The offline extractor's types, by the length of a name and of a pair.
TYPES = ["PERSON", "TECHNOLOGY", "ORGANIZATION", "EVENT", "CONCEPT", "PRODUCT", "DEPARTMENT"]
RELATIONS = ["caused", "led to", "developed"]
ORDER = ("doc_id", "idx", "pos")


def chunk(documents: DataFrame, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    """(chunk_id, doc_id, idx, text) of (doc_id, text); narrow, so it runs where the text is."""
    rows = documents.select("doc_id", F.posexplode(X.chunks(F.col("text"), size, overlap)).alias("idx", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", F.col("idx").cast("long").alias("idx"), "text")


def chunk_joined(files: DataFrame, group: str, order: str, folder: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap, between: str = "\n\n") -> DataFrame:
    """(chunk_id, doc_id, idx, text): the chunks of each ``group``'s files, taken as one text in ``order`` with ``between`` between
    them, as ``chunk`` would make them of it. The text is never put together: lengths are summed up in order, each file
    gives its share of every window that it reaches into, and a window joins its shares.

    A null text is empty; files of one place in the order stand by their text; windows that hold nothing but blanks fall away.
    """
    step = size - overlap
    rows = files.select(F.col(group).alias("doc_id"), F.col(order).alias("loam_order"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    keyed = materialize(rows.withColumn("loam_hash", F.xxhash64("text")).withColumn("loam_id", F.monotonically_increasing_id()), folder, "files")
    # lengths alone are sorted; a group begins where its first file does
    sizes = keyed.select("doc_id", "loam_order", "loam_hash", "loam_id", F.length("text").alias("loam_chars"))
    at = placed(sizes, ["doc_id", "loam_order", "loam_hash", "loam_id"], F.col("loam_chars") + len(between), folder, "sizes")
    at = materialize(at.select("doc_id", "loam_id", "loam_chars", "before"), folder, "places")
    starts = at.groupBy("doc_id").agg(F.min("before").alias("loam_start"), F.max_by("loam_id", "before").alias("loam_last"))
    at = at.join(materialize(starts, folder, "starts"), "doc_id").select("loam_id", (F.col("before") - F.col("loam_start")).alias("begin"), (F.col("loam_id") == F.col("loam_last")).alias("last"))
    rows = keyed.join(at, "loam_id").withColumn("text", F.concat("text", F.when(F.col("last"), "").otherwise(between)))
    rows = rows.withColumn("end", F.col("begin") + F.length("text")).filter("end > begin")
    first = F.greatest(F.lit(0), F.floor((F.col("begin") - size) / step) + 1)
    rows = rows.withColumn("window", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / step)))).withColumn("from", F.col("window") * step)
    low = F.greatest("begin", "from")
    share = F.substring("text", (low - F.col("begin") + 1).cast("int"), (F.least(F.col("end"), F.col("from") + size) - low).cast("int"))
    shares = rows.select("doc_id", "window", low.alias("low"), share.alias("share")).filter("share <> ''")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("low", "share"))), lambda x: x.share), "")
    made = shares.groupBy("doc_id", "window").agg(X.strip(whole).alias("text")).filter("text <> ''")
    # numbered through, group by group
    made = materialize(made, folder, "windows")
    nth = placed(made.select("doc_id", "window"), ["doc_id", "window"], F.lit(1), folder, "nth")
    nth = materialize(nth, folder, "numbers")
    zero = materialize(nth.groupBy("doc_id").agg(F.min("before").alias("zero")), folder, "zeros")
    nth = nth.join(zero, "doc_id").select("doc_id", "window", (F.col("before") - F.col("zero")).alias("idx"))
    out = made.join(nth, ["doc_id", "window"])
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", "text")


def _named(index, names: list[str]):
    return F.element_at(F.array(*map(F.lit, names)), (index % len(names)).cast("int") + 1)


def mentions(chunks: DataFrame, after: bool = False) -> DataFrame:
    """(doc_id, idx, pos, name, type, description), one row a mention; if asked for, with ``after``, the name that follows in the
    chunk, so that ``relationships`` needs no shuffle. A match of ``MENTION`` is a name in title case as it stands."""
    rows = chunks.select("doc_id", "idx", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)).alias("names"))
    # exploded as they are, the names would be looked for once more, to see whether there are any
    pairs = F.arrays_zip(F.col("names").alias("name"), F.slice("names", 2, F.size("names")).alias("after"))
    rows = rows.select("doc_id", "idx", F.posexplode(pairs).alias("pos", "found"))
    described = F.concat(F.lit("seen at "), F.col("pos").cast("string"), F.lit(" of chunk "), F.col("idx").cast("string"))
    follows = ["found.after"] if after else []
    return rows.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), "found.name", _named(F.length("found.name"), TYPES).alias("type"), described.alias("description"), *follows)


def relationships(found: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, source, target, type, evidence) between neighbouring mentions of a chunk."""
    follows = F.col("after") if "after" in found.columns else F.lead("name").over(Window.partitionBy("doc_id", "idx").orderBy("pos"))
    rows = found.select("doc_id", "idx", "pos", F.col("name").alias("source"), follows.alias("target")).filter("target is not null")
    kind = _named(F.length("source") + F.length("target"), RELATIONS)
    return rows.select("doc_id", "idx", "pos", "source", "target", kind.alias("type"), F.concat_ws(" then ", "source", "target").alias("evidence"))


def batches(chunks: DataFrame, size: int = DEFAULT.extraction_batch) -> DataFrame:
    """Prompt segments of ``size`` chunks of a document: (doc_id, batch, n_segments, segments)."""
    rows = chunks.withColumns({"batch": F.floor(F.col("idx") / size), "segment": F.col("idx") % size + 1})
    line = F.concat(F.lit("=== Segment "), F.col("segment").cast("string"), F.lit(" ===\n"), F.col("text"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", line.alias("line")))), lambda s: s.line), "\n\n")
    return rows.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n_segments"), listed.alias("segments"))


_ITEM = "segment int, entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,type:string,evidence:string>>"


def parse_replies(replies: DataFrame, size: int = DEFAULT.extraction_batch) -> DataFrame:
    """(doc_id, idx, entities, relationships) from replies: a list is aligned by its ``segment``
    numbers, else by position; an object stands for the first segment; others are empty."""
    body = X.reply_json(F.col("reply"))
    is_list = F.startswith(F.ltrim(body), F.lit("["))
    items = F.when(is_list, F.from_json(body, f"array<struct<{_ITEM.replace(' int', ':int').replace(' array', ':array')}>>")).otherwise(F.array(F.from_json(body, _ITEM)))
    rows = replies.select("doc_id", "batch", F.posexplode(items).alias("k", "item"))
    place = F.when(F.col("item.segment").isNotNull(), F.col("item.segment")).otherwise(F.col("k") + 1)
    # a repeated segment number: the last one stands
    rows = rows.groupBy("doc_id", "batch", place.alias("segment")).agg(F.max_by("item", "k").alias("item"))
    none = F.array()
    return rows.filter(F.col("segment").between(1, size)).select(
        "doc_id", (F.col("batch") * size + F.col("segment") - 1).alias("idx"),
        F.coalesce("item.entities", none.cast("array<struct<name:string,type:string,description:string>>")).alias("entities"),
        F.coalesce("item.relationships", none.cast("array<struct<source:string,target:string,type:string,evidence:string>>")).alias("relationships"),
    )


def totals(extractions: DataFrame) -> DataFrame:
    """One row: entities and relationships in all replies."""
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c)
    return extractions.agg(F.count(F.lit(1)).alias("chunks"), count("entities"), count("relationships"))
