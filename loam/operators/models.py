"""Functions backed by a language model: extraction, concepts, summaries, answers, judges, metrics.

A client is any picklable function from a prompt to a reply. Calls run inside partitions, under
a share of the rate limit, and every reply is kept as it comes (``replies``): they cost money and may
differ when asked for again. Prompts and replies are built and parsed in
expressions. Every function has a deterministic stand-in elsewhere, so nothing needs a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.config import DEFAULT, Config
from loam.functions import text as X
from loam.functions import vector as V
from loam.operators import concepts, evaluate, extract
from loam.operators import replies as R
from loam.store import workspace

Client = Callable[[str], str]
ENTITY_WORDS = "entities (name, type, description) and relationships (source, target, type, evidence)"


def call_each(rows: DataFrame, client: Client, prompt: str = "prompt", tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> DataFrame:
    """``rows`` with a ``reply`` to each ``prompt`` (see ``replies.ask``), kept in the folder ``replies``; a prompt over
    the model's size gives a null reply."""
    return R.ask(rows, client, replies or workspace(rows.sparkSession, "replies"), prompt, tasks, config)


def extraction_prompts(segments: DataFrame) -> DataFrame:
    ask = F.concat(F.lit("For each of the "), F.col("n_segments").cast("string"), F.lit(f" numbered segments return a JSON list with {ENTITY_WORDS}.\n\n"), F.col("segments"))
    return segments.withColumn("prompt", ask)


def extract_adaptive(chunks: DataFrame, client: Client, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> DataFrame:
    """(doc_id, idx, entities, relationships) of every chunk. Batches that are too large for the
    model go again chunk by chunk, as do batches without any entity; what still fails is empty."""
    replies = replies or workspace(chunks.sparkSession, "replies")
    first = call_each(extraction_prompts(extract.batches(chunks, config.extraction_batch)), client, tasks=tasks, config=config, replies=replies)
    found = extract.parse_replies(first.select("doc_id", F.col("batch").cast("long").alias("batch"), F.coalesce("reply", F.lit("")).alias("reply")), config.extraction_batch)
    filled = found.filter(F.size("entities") > 0)
    done = filled.select("doc_id", F.floor(F.col("idx") / config.extraction_batch).alias("batch")).distinct()
    again = chunks.withColumn("batch", F.floor(F.col("idx") / config.extraction_batch)).join(done, ["doc_id", "batch"], "left_anti")
    single = call_each(extraction_prompts(extract.batches(again.drop("batch"), 1)), client, tasks=tasks, config=config, replies=replies)
    second = extract.parse_replies(single.select("doc_id", F.col("batch").cast("long").alias("batch"), F.coalesce("reply", F.lit("")).alias("reply")), 1)
    return filled.unionByName(second.filter(F.size("entities") > 0))


def named_mentions(extractions: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, name, type, description) from extractions, names in title case."""
    rows = extractions.select("doc_id", "idx", F.posexplode("entities").alias("pos", "e"))
    return rows.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), X.entity_name(F.col("e.name")).alias("name"), F.coalesce("e.type", F.lit("OTHER")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description")).filter("name <> ''")


def named_relationships(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("doc_id", "idx", F.posexplode("relationships").alias("pos", "r"))
    return rows.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), X.entity_name(F.col("r.source")).alias("source"), X.entity_name(F.col("r.target")).alias("target"), "r.type", F.coalesce("r.evidence", F.lit("")).alias("evidence"))


FLAT = "entities array<struct<name:string,type:string>>, relationships array<struct<source:string,target:string,type:string,evidence:string>>"


def extract_flat(chunks: DataFrame, client: Client, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The flat pipeline's own extraction: each chunk alone, its first ``flat_extract_chars``
    characters. (doc_id, idx, pos, name, type) of mentions, names as written, and (doc_id, idx, pos,
    source, target, type, evidence) of relationships; a reply that is no object holds nothing."""
    ask = F.concat(F.lit(f"Return JSON with the {ENTITY_WORDS} of this text.\n\n"), F.substring("text", 1, config.flat_extract_chars))
    told = call_each(chunks.select("doc_id", "idx", ask.alias("prompt")), client, tasks=tasks, config=config, replies=replies)
    body = X.reply_json(F.coalesce("reply", F.lit("")))
    rows = told.select("doc_id", "idx", F.when(~F.startswith(F.ltrim(body), F.lit("[")), F.from_json(body, FLAT)).alias("found"))
    named = rows.select("doc_id", "idx", F.posexplode("found.entities").alias("pos", "e"))
    named = named.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), X.strip(F.coalesce("e.name", F.lit(""))).alias("name"), F.coalesce("e.type", F.lit("UNKNOWN")).alias("type")).filter("name <> ''")
    edges = rows.select("doc_id", "idx", F.posexplode("found.relationships").alias("pos", "r"))
    return named, edges.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), "r.source", "r.target", "r.type", F.coalesce("r.evidence", F.lit("")).alias("evidence"))


#: Seconds before concepts are asked for again, by attempt, where no reply held any.
CONCEPT_PAUSES = (60, 120, 180)


def draft_concepts(entities: DataFrame, client: Client, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(concept, member, place) from a client, asked about batches of entity lines. Where no reply
    holds a concept, all batches are asked again, up to three times, after growing pauses."""
    prompts = concepts.entity_prompt(entities, workspace(entities.sparkSession, "concepts"), config.entity_text_chars, config.concept_batch)
    prompts = prompts.withColumn("prompt", F.concat(F.lit('Group these entities: JSON {"concepts": [{"name", "description", "members"}]}, exact names.\n'), F.col("listing")))
    parsed = F.from_json(X.reply_json(F.coalesce("reply", F.lit(""))), "concepts array<struct<name:string,description:string,members:array<string>>>")
    for turn, pause in enumerate((*CONCEPT_PAUSES, None)):
        # a blank more each time, as the same prompt would be answered from what is kept
        found = call_each(prompts.withColumn("prompt", F.concat("prompt", F.lit(" " * turn))), client, tasks=tasks, config=config, replies=replies).select(F.explode(parsed["concepts"]).alias("c"))
        if pause is None or not found.isEmpty():
            break
        sleep(pause)
    rows = found.select(X.strip(F.coalesce("c.name", F.lit("Unknown Concept"))).alias("concept"), F.posexplode("c.members").alias("place", "member"))
    return rows.select("concept", X.strip(F.col("member")).alias("member"), F.col("place").cast("int").alias("place"))


#: Members named when a prompt with all of them is too large.
FEWER_MEMBERS = 15


def summaries(communities: DataFrame, client: Client, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> DataFrame:
    """``communities`` (community, members, ..) with a client's summary. A prompt that is too large
    is asked again with the first ``FEWER_MEMBERS`` members, which a community of more members (``n_members``) than
    are held as a value is asked with at once; an empty reply falls back to the list."""
    rows = communities.drop("summary")
    columns = rows.columns

    def ask(some: DataFrame, members) -> DataFrame:
        said = some.withColumn("loam_listed", F.array_join(members, ", "))
        return call_each(said.withColumn("prompt", F.concat(F.lit("Summarise what unites: "), F.col("loam_listed"))), client, tasks=tasks, config=config, replies=replies).drop("prompt")

    fewer = F.slice("members", 1, FEWER_MEMBERS)
    # a list of several pages is too large for any prompt
    asked = ask(rows, F.when(F.col("n_members") > F.size("members"), fewer).otherwise(F.col("members")) if "n_members" in columns else F.col("members"))
    again = asked.filter("reply is null").select(*columns)
    if not again.isEmpty():
        asked = asked.filter("reply is not null").unionByName(ask(again, fewer))
    return asked.select(*columns, X.fallback_summary(X.strip_think(F.coalesce("reply", F.lit(""))), F.col("loam_listed")).alias("summary"))


def answers(prompts: DataFrame, client: Client, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> DataFrame:
    """(qid, answer) to (qid, prompt)."""
    return call_each(prompts, client, tasks=tasks, config=config, replies=replies).select("qid", X.strip_think(F.coalesce("reply", F.lit(""))).alias("answer"))


def judged(rows: DataFrame, client: Client, items: str, flag: str, said: str, out: str, tasks: int = 1, config: Config = DEFAULT, replies: str | None = None) -> DataFrame:
    """(qid, ``out``): a judge's score of the text ``said`` against the first chunks of ``chunks``."""
    shown = F.array_join(F.slice("chunks", 1, config.judge_chunks), "\n\n---\n\n")
    prompts = rows.withColumn("prompt", F.concat(F.lit(f'JSON {{"{items}": [{{"{flag}"}}], "score"}}.\nContext:\n'), shown, F.lit("\nText:\n"), F.col(said)))
    scored = call_each(prompts, client, tasks=tasks, config=config, replies=replies)
    score = evaluate.judge_score(F.coalesce("reply", F.lit("")), items, flag)
    return scored.select("qid", F.when((F.size("chunks") == 0) | (F.coalesce(F.col(said), F.lit("")) == ""), F.lit(0.0)).otherwise(score).alias(out))


def metrics(rows: DataFrame, embed: Callable[..., DataFrame] = V.embed) -> DataFrame:
    """(qid, category, four metrics) of (qid, category, query, answer, ground_truth, chunks), by
    the offline judge: words of the answer or truth that the context holds."""
    joined = F.array_join(F.slice("chunks", 1, DEFAULT.judge_chunks), " ")
    out = embed(embed(rows, "qid", "query", "loam_q"), "qid", "answer", "loam_a")
    out = out.withColumns({"answer_relevancy": evaluate.answer_relevancy(F.col("loam_q"), F.col("loam_a")), "faithfulness": evaluate.contained_score(F.col("answer"), joined), "context_recall": evaluate.contained_score(F.col("ground_truth"), joined)})
    each = embed(rows.select("qid", "query", F.explode("chunks").alias("loam_c")), "qid", "loam_c", "loam_v")
    each = embed(each, "qid", "query", "loam_q").select("qid", V.cosine(F.col("loam_q"), F.col("loam_v")).alias("similarity"))
    relevance = evaluate.average_relevance(each).select("qid", "avg_relevance_score")
    return out.join(relevance, "qid", "left").select("qid", "category", "answer_relevancy", "faithfulness", "context_recall", F.coalesce("avg_relevance_score", F.lit(0.0)).alias("avg_relevance_score"))
