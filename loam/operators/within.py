"""Which texts hold which terms as substrings: an automaton of many terms reads each text once.

Terms are dealt into slices of bounded size; a task holds the automaton of one slice (Aho and Corasick, 1975) and
reads every text letter by letter, whatever the number or the length of the terms. Texts are sent to every slice, so
one slice is the rule and large tables of terms cost as many readings as they have slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of an automaton, and characters of all of them, at most.
TERMS, CHARACTERS = 200_000, 4 << 20


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term) of the texts of each slice, whose terms come first."""
    current, automaton, made = None, None, False
    for batch in batches:
        keys, found = [], []
        for number, term, key, text in zip(*(batch.column(c).to_pylist() for c in ("slice", "term", "key", "text")), strict=True):
            if number != current:
                current, automaton, made = number, ahocorasick.Automaton(), False
            if key is None:
                automaton.add_word(term, term)
                continue
            if not made:
                automaton.make_automaton()
                made = True
            if len(automaton):
                held = {hit for _, hit in automaton.iter(text)}
                keys += [key] * len(held)
                found += held
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "term"])


def holding(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """The columns of both for each text that holds a term (not the empty one) as a substring."""
    known = terms.filter(F.length(term) > 0).select(F.col(term).alias("term")).distinct()
    n, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    slices = max(1, -(-n // TERMS), -(-chars // CHARACTERS))
    keyed = texts.withColumn("loam_key", F.sha2(F.col(text), 256))
    asked = keyed.filter(F.length(text) > 0).select(F.col("loam_key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    none = F.lit(None).cast("string")
    own = known.select(F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"), "term", none.alias("key"), none.alias("text"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), none.alias("term"), "key", "text")
    met = own.unionByName(sent).repartition(slices, "slice").sortWithinPartitions("slice", F.col("key").asc_nulls_first())
    hits = met.mapInArrow(_pairs, "key string, term string").select(F.col("key").alias("loam_key"), F.col("term").alias("loam_term"))
    return keyed.join(hits, "loam_key").join(terms, F.col("loam_term") == F.col(term)).drop("loam_key", "loam_term")
