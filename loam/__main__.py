"""Command line: build a graph, ask it, compare pipelines, trace a question, export.

    python -m loam build INPUT STORE            INPUT: a directory, or a .txt or .pdf file
    python -m loam ask STORE QUESTION           the graph's prompt, after what retrieval went through
    python -m loam baseline STORE QUESTION      the prompt of vector search alone
    python -m loam flat STORE QUESTION          the prompt of vector search and the flat index
    python -m loam live STORE                   questions from the keyboard, until an empty line
    python -m loam benchmark STORE QUESTIONS --out FOLDER   all questions of a CSV or JSON file
    python -m loam trace STORE QUESTION
    python -m loam export STORE TARGET          hierarchy, nodes, edges and a page (--question: marked)

Run it with spark-submit on a cluster; settings are read from LOAM_* variables and loam.* settings.
``--client MODULE:FUNCTION`` names a model, a function from a prompt to a reply: the build asks it for entities,
concepts and summaries, the others for answers and the benchmark for its judgements; ``--replies FOLDER`` keeps what
it said, so that a run that was broken off goes on. Without one the commands print prompts, and the benchmark
judges an extract of the context. ``--embed MODULE:FUNCTION`` names a vector model, a function from texts to a
matrix; a store remembers which one it was built with. ``--cache FOLDER`` keeps a build's extractions by input path.
"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import Config
from loam.functions import vector as V
from loam.operators import evaluate, explain, extract, flat, graph, models, resolve, retrieve
from loam.session import get_spark
from loam.sources import pdf, readers, sinks
from loam.store import workspace


@dataclass
class Models:
    """What the command line names: a client and a vector model as MODULE:FUNCTION, and where replies are kept."""

    client: str | None = None
    vectors: str | None = None
    replies: str | None = None
    tasks: int = 1

    @staticmethod
    def _named(name: str):
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)

    def ask(self) -> dict:
        return {"client": self._named(self.client) if self.client else None, "replies": self.replies, "tasks": self.tasks}

    @property
    def embed(self):
        return V.model_embed(self._named(self.vectors)) if self.vectors else V.embed

    def check(self, spark: SparkSession, store: str) -> None:
        """Vectors of two models have no likeness: a store is asked with the one that it was built with."""
        kept = spark.read.json(f"{store}/vectors").first().vectors
        if kept != (self.vectors or "words"):
            raise ValueError(f"{store} was built with the vector model {kept}, not {self.vectors or 'words'}")


OFFLINE = Models()


def asked(spark: SparkSession, question: str, use: Models = OFFLINE) -> DataFrame:
    return use.embed(spark.createDataFrame([(1, question)], "qid long, query string"), "qid", "query", "q")


def build(spark: SparkSession, source: str, store: str, use: Models = OFFLINE, cache: str | None = None) -> None:
    config = Config.load(spark)
    files, name = readers.read_input(spark, source, pdf.pages)
    # all files are one document, a blank line between them, and its chunks run over their borders
    folder = workspace(spark, "build")
    files = files.withColumn("doc_id", F.xxhash64(F.lit(name)))
    chunks = extract.chunk_joined(files, "doc_id", "file_name", folder, config.chunk_size, config.chunk_overlap)
    chars = (F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("n_chars")
    docs = files.groupBy("doc_id").agg(chars).withColumn("source", F.lit(name))
    known = readers.read_cache(spark, cache, source) if cache else None
    built = graph.build(docs, config, folder, embed=use.embed, extracted=known, chunks=chunks, **use.ask())
    if cache and known is None and use.client:
        sinks.write_cache(spark.read.parquet(f"{folder}/extraction"), cache, source)
    built.save(store)
    sinks.write_json(spark.createDataFrame([(use.vectors or "words",)], "vectors string"), f"{store}/vectors")
    sinks.write_json(graph.statistics(built, docs, config).withColumn("document", F.lit(name)), f"{store}/statistics")


def retrieval(spark: SparkSession, store: str, questions: DataFrame, use: Models = OFFLINE) -> retrieve.Retrieval:
    use.check(spark, store)
    return retrieve.Retrieval(questions, graph.Graph.load(spark, store), Config.load(spark), workspace(spark, "retrieval"))


def graph_texts(found: retrieve.Retrieval) -> DataFrame:
    return retrieve.in_reading_order(found.context, found.graph)


def vector_texts(found: retrieve.Retrieval) -> DataFrame:
    return retrieve.by_rank(retrieve.top_chunks(found.questions, found.graph.chunk, found.config.top_k_chunks), found.graph)


def flat_parts(spark: SparkSession, store: str, found: retrieve.Retrieval) -> tuple[DataFrame, DataFrame]:
    """(qid, chunks) and (qid, place, source, target, type, evidence) of the flat pipeline."""
    matched = flat.mentioned(found.questions, found.graph.flat_entity)
    vector = retrieve.top_chunks(found.questions, found.graph.chunk, found.config.flat_top_k)
    merged = flat.merged_context(vector, matched, resolve.flat_postings(found.graph.mention), found.config)
    return retrieve.by_rank(merged.withColumnRenamed("place", "rank"), found.graph), flat.matched_relationships(matched, found.graph.claim, found.config)


def ask(spark: SparkSession, store: str, question: str, found: retrieve.Retrieval | None = None, use: Models = OFFLINE) -> DataFrame:
    found = found or retrieval(spark, store, asked(spark, question, use), use)
    return retrieve.formed("graph", found.questions, retrieve.chained(found.relationships), graph_texts(found))


def baseline(spark: SparkSession, store: str, question: str, use: Models = OFFLINE) -> DataFrame:
    found = retrieval(spark, store, asked(spark, question, use), use)
    return retrieve.formed("baseline", found.questions, None, vector_texts(found))


def flat_prompt(spark: SparkSession, store: str, question: str, use: Models = OFFLINE) -> DataFrame:
    found = retrieval(spark, store, asked(spark, question, use), use)
    texts, edges = flat_parts(spark, store, found)
    return retrieve.formed("flat", found.questions, edges, texts, "place")


def benchmark(spark: SparkSession, store: str, questions: str, out: str, use: Models = OFFLINE) -> DataFrame:
    """(category, metric, pipeline's means and the graph's lead): all questions through the three
    pipelines, answered and judged by the client or offline; details and means are written under ``out``."""
    rows = readers.read_questions(spark, questions).withColumn("qid", F.xxhash64("id"))
    found = retrieval(spark, store, use.embed(rows, "qid", "query", "q"), use)
    flat_texts, flat_edges = flat_parts(spark, store, found)
    texts = {"baseline": vector_texts(found), "flat": flat_texts, "graph": graph_texts(found)}
    edges = {"baseline": (None, "step"), "flat": (flat_edges, "place"), "graph": (retrieve.chained(found.relationships), "step")}
    means = {}
    for name, chunks in texts.items():
        shown = rows.join(chunks, "qid", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
        extractive = F.array_join(F.slice("chunks", 1, 1), "")  # the offline stand-in for a model's answer
        shown = shown.select("qid", "category", "query", extractive.alias("answer"), "ground_truth", "chunks")
        if use.client:
            told = models.answers(retrieve.formed(name, found.questions, edges[name][0], chunks, edges[name][1]), **use.ask())
            shown = shown.drop("answer").join(told, "qid")
        judged = models.metrics(shown, use.embed)
        if use.client:
            for metric, items, flag, said in (("faithfulness", "claims", "supported", "answer"), ("context_recall", "facts", "present", "ground_truth")):
                judged = judged.drop(metric).join(models.judged(shown, items=items, flag=flag, said=said, out=metric, **use.ask()), "qid")
        judged.write.mode("overwrite").json(f"{out}/detailed/{name}")
        means[name] = evaluate.roll_up(spark.read.schema(judged.schema).json(f"{out}/detailed/{name}"))
        sinks.write_json(means[name], f"{out}/aggregated/{name}")
    table = evaluate.compare(means["baseline"], means["graph"])
    side = means["flat"].unpivot(["category"], list(evaluate.METRICS), "metric", "flat")
    return table.join(side, ["category", "metric"], "left").select("category", "metric", "baseline", "flat", "graph", "delta", "better")


def say(prompt: DataFrame, use: Models) -> None:
    """A question's prompt, or the client's answer to it."""
    print(models.answers(prompt, **use.ask()).first().answer if use.client else prompt.first().prompt)


def show(found: retrieve.Retrieval, prompt: DataFrame, use: Models = OFFLINE) -> None:
    for r in retrieve.path_lines(found).orderBy("section", "place").toLocalIterator():
        print(r.line)
    print()
    say(prompt, use)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loam", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=["build", "ask", "baseline", "flat", "live", "benchmark", "trace", "export"])
    parser.add_argument("first")
    parser.add_argument("second", nargs="?")
    parser.add_argument("--out", default="results")
    parser.add_argument("--question")
    for name in ("client", "embed", "replies", "cache"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--tasks", type=int, default=1)
    args = parser.parse_args(argv)
    use = Models(args.client, args.embed, args.replies, args.tasks)
    if args.second is None and args.action != "live":
        parser.error(f"{args.action} needs two arguments")
    spark = get_spark("loam")
    if args.action == "build":
        build(spark, args.first, args.second, use, args.cache)
    elif args.action in ("ask", "live"):
        for question in [args.second] if args.action == "ask" else iter(lambda: input("question: ").strip(), ""):
            found = retrieval(spark, args.first, asked(spark, question, use), use)
            show(found, ask(spark, args.first, question, found), use)
    elif args.action in ("baseline", "flat"):
        say({"baseline": baseline, "flat": flat_prompt}[args.action](spark, args.first, args.second, use), use)
    elif args.action == "benchmark":
        for r in benchmark(spark, args.first, args.second, args.out, use).orderBy("category", "metric").toLocalIterator():
            print(f"{r.category:12} {r.metric:22} {r.baseline:8.4f} {r.flat:8.4f} {r.graph:8.4f} {r.delta:+8.4f}{' *' if r.better else ''}")
    elif args.action == "trace":
        for r in explain.trace(asked(spark, args.second, use), graph.Graph.load(spark, args.first), Config.load(spark), workspace(spark, "trace")).orderBy("stage", "rank").toLocalIterator():
            print(f"{r.stage:14} {r.rank:3} {r.score:8.4f} {r.bar} {r.flag:16} {r.item}")
    else:
        stored = graph.Graph.load(spark, args.first)
        sinks.write_text(explain.hierarchy_lines(stored).orderBy("community", "concept", "entity"), f"{args.second}/hierarchy", "line")
        sinks.write_json(explain.nodes(stored), f"{args.second}/nodes")
        sinks.write_json(explain.edges(stored), f"{args.second}/edges")
        shown = explain.overlay(retrieval(spark, args.first, asked(spark, args.question, use), use)) if args.question else None
        sinks.write_text(explain.html(stored, shown), f"{args.second}/page")


if __name__ == "__main__":
    main()
