"""Model-backed functions with stand-in clients, and the command line's steps."""

import json

from loam import __main__ as cli
from loam.operators import client, extract, models, resolve


def extractor():
    """A client made here travels to the workers by value."""

    def reply(prompt):
        parts = prompt.split("=== Segment ")[1:]
        if len(parts) > 2:
            raise client.TokenLimitError
        return json.dumps([{"segment": int(p[0]), "entities": [{"name": p.split("\n")[1].split()[0], "type": "ORG"}], "relationships": [{"source": "a", "target": "b", "type": "led"}]} for p in parts])

    return reply


def test_batches_too_large_go_chunk_by_chunk(spark):
    rows = [(1, k, f"name{k} text") for k in range(5)] + [(2, 0, "solo x")]
    chunks = spark.createDataFrame(rows, "doc_id long, idx long, text string")
    found = models.extract_adaptive(chunks, extractor())
    assert found.count() == 6
    names = {(r.doc_id, r.idx): r.name for r in models.named_mentions(found).collect()}
    assert names == {(d, i): t.split()[0].title() for d, i, t in rows}
    edges = models.named_relationships(found).collect()
    assert {(r.source, r.target) for r in edges} == {("A", "B")}
    assert resolve.merge_entities(models.named_mentions(found)).count() == 6


def test_concepts_summaries_and_answers(spark):
    found = extract.mentions(spark.createDataFrame([(1, 0, "Alphaone Betatwo")], "doc_id long, idx long, text string"))
    reply = json.dumps({"concepts": [{"name": " Both ", "members": ["Alphaone", "Betatwo"]}, {"members": ["x"]}]})
    drafted = models.draft_concepts(resolve.merge_entities(found), lambda p: reply).collect()
    assert [(r.concept, r.member) for r in drafted] == [("Both", "Alphaone"), ("Both", "Betatwo"), ("Unknown Concept", "x")]
    groups = spark.createDataFrame([("c0", ["a", "b"])], "community string, members array<string>")
    assert models.summaries(groups, lambda p: "").first().summary == "Community covering: a, b"
    assert models.summaries(groups, lambda p: "<think>x</think> fine").first().summary == "fine"
    asked = spark.createDataFrame([(1, "why?")], "qid long, prompt string")
    assert models.answers(asked, lambda p: f"because {p}").first().answer == "because why?"


def counting(folder, reply):
    """A client that leaves a file for each call, so calls in any process count."""
    import uuid

    def ask(prompt):
        (folder / uuid.uuid4().hex).write_text(prompt)
        return reply(prompt)

    return ask


def test_a_client_sees_every_prompt_once(spark, tmp_path):
    chunks = spark.createDataFrame([(1, k, f"name{k} text") for k in range(3)] + [(2, 0, "none")], "doc_id long, idx long, text string")
    first = lambda p: json.dumps([{"segment": k, "entities": [{"name": "x", "type": "ORG"}] if "name0" in p else []} for k in (1, 2, 3)])
    found = models.extract_adaptive(chunks, counting(tmp_path, first))
    assert found.count() == 3 and found.count() == 3 and extract.totals(found).first().entities == 3
    # one batch a document; the batch without an entity, asked chunk by chunk, is the prompt that was answered
    assert len(list(tmp_path.iterdir())) == 2


def test_flat_extraction_reads_the_beginning_of_a_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "a" * 2000 + "TAIL"), (1, 1, "broken")], "doc_id long, idx long, text string")
    reply = json.dumps({"entities": [{"name": " Acme "}, {"name": ""}], "relationships": [{"source": "Acme", "target": "B", "type": "OWNS"}]})
    named, edges = models.extract_flat(chunks, counting(tmp_path, lambda p: "oops" if "broken" in p else reply))
    assert [(r.idx, r.name, r.type) for r in named.collect()] == [(0, "Acme", "UNKNOWN")]
    assert [(r.source, r.target, r.evidence) for r in edges.collect()] == [("Acme", "B", "")]
    assert not any("TAIL" in p.read_text() for p in tmp_path.iterdir())


def test_concepts_are_asked_for_again(spark):
    found = extract.mentions(spark.createDataFrame([(1, 0, "Alphaone Betatwo")], "doc_id long, idx long, text string"))
    slept = []
    assert models.draft_concepts(resolve.merge_entities(found), lambda p: "nothing", sleep=slept.append).count() == 0
    assert slept == [60, 120, 180]


def test_summaries_of_large_communities_name_fewer_members(spark):
    groups = spark.createDataFrame([("c0", [f"m{k:02}" for k in range(40)]), ("c1", ["a"])], "community string, members array<string>")
    TokenLimit = client.TokenLimitError

    def ask(prompt):
        if prompt.count(",") >= 15:
            raise TokenLimit
        return "" if "m00" in prompt else "fine"

    got = {r.community: r.summary for r in models.summaries(groups, ask).collect()}
    assert got == {"c0": "Community covering: " + ", ".join(f"m{k:02}" for k in range(15)), "c1": "fine"}


def test_fatal_errors_are_not_tried_again():
    import pytest

    for text, kind in (("Error 401: invalid api key", client.FatalError), ("413 request too large", client.TokenLimitError), ("daily quota reached", client.QuotaError)):
        calls = []

        def broken(prompt, text=text, calls=calls):
            calls.append(prompt)
            raise RuntimeError(text)

        with pytest.raises(kind):
            client.call(broken, "p", client.RateLimiter(100), sleep=lambda s: None)
        assert len(calls) == 1
    def failing(text):
        def ask(prompt):
            raise RuntimeError(text)

        return ask

    for text, pauses in (("429 rate_limit", [60.0, 120.0]), ("Connection reset by peer", [10.0, 20.0])):
        slept = []
        assert client.call(failing(text), "p", client.RateLimiter(100), attempts=3, sleep=slept.append) == "" and slept == pauses
    with pytest.raises(client.CallError):
        client.call(failing("something odd"), "p", client.RateLimiter(100), attempts=2, sleep=lambda s: None)


def test_what_messages_say_about_an_error():
    # fixed values: messages, and the kind of each
    for text, kind in (
        ("Error code: 413 - request entity", "tokens"), ("Requested 9000 tokens, limit 6000", "tokens"), ("context_length_exceeded", "tokens"), ("Prompt too large", "tokens"),
        ("Error code: 429", "busy"), ("rate_limit_exceeded", "busy"), ("daily cap", "quota"), ("insufficient_quota", "quota"), ("HTTP 401", "fatal"), ("status=403.", "fatal"),
        ("took 4030 ms", "other"), ("id 1429x4", "other"), ("4.413 s", "other"), ("read timeout", "network"), ("ssl: eof", "network"), ("odd", "other"),
    ):
        assert client.kind_of(RuntimeError(text)) == kind, text


def test_a_broken_run_goes_on_without_asking_twice(spark, tmp_path):
    import collections

    import pytest

    calls, folder = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    rows = spark.createDataFrame([(k, f"prompt {k % 9}" if k else None) for k in range(20)], "k long, prompt string")

    def dying(prompt):
        import os

        (calls / f"{prompt}-{len(list(calls.iterdir()))}").write_text(prompt)
        if len(list(calls.iterdir())) == 5:
            os._exit(1)  # the task's process is lost
        return prompt.upper()

    with pytest.raises(Exception):  # noqa: B017
        models.call_each(rows, dying, replies=folder)
    assert len(list(calls.iterdir())) == 5
    got = {r.k: r.reply for r in models.call_each(rows, dying, tasks=2, replies=folder).collect()}
    assert got == {k: (f"PROMPT {k % 9}" if k else None) for k in range(20)}
    asked = collections.Counter(p.read_text() for p in calls.iterdir())
    # the one in whose middle the process went had no reply yet
    assert sorted(asked.values()) == [1] * 8 + [2]
    before = len(list(calls.iterdir()))
    assert models.call_each(rows, dying, replies=folder).count() == 20 and len(list(calls.iterdir())) == before


def test_failures_are_rows_and_only_they_are_asked_again(spark, tmp_path):
    import pytest

    calls, folder = tmp_path / "calls", str(tmp_path / "replies")
    calls.mkdir()
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "k long, prompt string")
    spent = tmp_path / "spent"
    spent.write_text("")

    def ask(prompt):
        (calls / f"{prompt}-{len(list(calls.iterdir()))}").write_text(prompt)
        if prompt == "p1":
            raise RuntimeError("413")
        if prompt == "p3" and spent.exists():
            raise RuntimeError("daily quota reached")
        return prompt + "!"

    from loam.operators import replies

    with pytest.raises(client.QuotaError):
        models.call_each(rows.orderBy("k").coalesce(1), ask, replies=folder)
    kinds = {r.kind for r in replies.table(spark, folder).collect()}
    assert "quota" in kinds
    spent.unlink()
    told = {r.k: r.reply for r in models.call_each(rows, ask, replies=folder).collect()}
    assert told == {k: None if k == 1 else f"p{k}!" for k in range(6)}
    seen = [p.read_text() for p in calls.iterdir()]
    assert all(seen.count(f"p{k}") == (2 if k == 3 else 1) for k in range(6))


def test_calls_of_the_minute_before_count():
    now = [1000.0]
    limiter = client.RateLimiter(4, 2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s), used=[990.0, 995.0])
    limiter.wait()
    assert now[0] == 990 + client.SPAN
    limiter.wait()
    assert now[0] == 995 + client.SPAN


def builder():
    """A model for a whole build: entities and a relationship a segment, one concept, a summary."""
    def reply(prompt):
        if "Group these entities" in prompt:
            names = [line[2:].split(" [")[0] for line in prompt.split("\n") if line.startswith("- ")]
            return json.dumps({"concepts": [{"name": "All of it", "members": names}]})
        if prompt.startswith("Summarise"):
            return "a summary"
        if "=== Segment" in prompt:
            words = [[w.strip(".") for w in p.split() if w[:1].isupper()] for p in prompt.split("===\n")[1:]]
            return json.dumps([{"segment": k, "entities": [{"name": n, "type": "ORG", "description": f"{n} is"} for n in w], "relationships": [{"source": w[0], "target": w[-1], "type": "met", "evidence": "e"}]} for k, w in enumerate(words, 1)])
        return "an answer"

    return reply


def test_a_graph_built_by_a_model(spark, tmp_path):
    from loam.operators import graph

    docs = spark.createDataFrame([(k, f"{a} meets {b}. {a} leaves {b}.", "s") for k, (a, b) in enumerate([("Alphaone", "Betatwo"), ("Betatwo", "Gammathree")])], "doc_id long, text string, source string")
    built = graph.build(docs, client=builder(), replies=str(tmp_path / "replies"))
    assert {r.name for r in built.entity.collect()} == {"Alphaone", "Betatwo", "Gammathree"}
    assert {(r.source, r.type, r.target) for r in built.relation.collect()} == {("Alphaone", "MET", "Betatwo"), ("Betatwo", "MET", "Gammathree")}
    assert [(r.summary, r.members) for r in built.community.collect()] == [("a summary", ["Alphaone", "Betatwo", "Gammathree"])]

    def silent(prompt):
        raise AssertionError(prompt)

    again = graph.build(docs, client=silent, replies=str(tmp_path / "replies"))  # all is kept
    assert again.entity.select("name").exceptAll(built.entity.select("name")).isEmpty()


def test_the_command_line_takes_models_and_keeps_what_they_said(spark, tmp_path, capsys, monkeypatch):
    import sys

    import pytest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Alphaone meets Betatwo.")
    (tmp_path / "said.py").write_text("""import json
def client(prompt):
    if "Group these" in prompt:
        return json.dumps({"concepts": [{"name": "Both", "members": ["Alphaone", "Betatwo"]}]})
    if "=== Segment" in prompt:
        return json.dumps([{"segment": 1, "entities": [{"name": "Alphaone"}, {"name": "Betatwo"}], "relationships": []}])
    return "forty-two"
def vectors(texts):
    import numpy as np
    return np.array([[len(t) + 1.0, t.count("e"), 1.0] for t in texts])
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "said.py"))
    monkeypatch.setattr(cli, "get_spark", lambda app: spark)
    store, models_ = str(tmp_path / "store"), ["--client", "said:client", "--embed", "said:vectors", "--replies", str(tmp_path / "kept"), "--cache", str(tmp_path / "cache")]
    cli.main(["build", str(tmp_path / "in"), store, *models_])
    assert len(list((tmp_path / "cache").iterdir())) == 1
    cli.main(["build", str(tmp_path / "in"), store, *models_])  # from the cache
    cli.main(["ask", store, "What does Alphaone do?", *models_])
    assert "forty-two" in capsys.readouterr().out
    with pytest.raises(ValueError, match="said:vectors"):
        cli.main(["ask", store, "What does Alphaone do?"])
    sys.modules.pop("said", None)


def test_no_minute_holds_more_calls_than_allowed():
    import pytest

    for per_minute, tasks in ((28, 1), (28, 3), (28, 28), (1, 1)):
        at = []
        for _ in range(tasks):
            now = [0.0]
            limiter = client.RateLimiter(per_minute, tasks, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s))
            for _ in range(40):
                limiter.wait()
                at.append(now[0])
        assert max(sum(1 for u in at if t <= u <= t + 60) for t in at) <= per_minute
    with pytest.raises(ValueError):
        client.RateLimiter(28, 29)


def test_metrics_and_judges(spark):
    rows = spark.createDataFrame([(1, "factual", "where is the tower", "the tower stands", "the tower", ["the tower stands here"]), (2, "global", "x", "", "y", [])], "qid long, category string, query string, answer string, ground_truth string, chunks array<string>")
    got = {r.qid: r for r in models.metrics(rows).collect()}
    assert got[1].faithfulness == got[1].context_recall == 1.0 and 0 < got[1].avg_relevance_score <= 1
    assert got[2].faithfulness == got[2].avg_relevance_score == 0.0
    scores = {r.qid: r.f for r in models.judged(rows, lambda p: '{"score": 0.75}', "claims", "supported", "answer", "f").collect()}
    assert scores == {1: 0.75, 2: 0.0}


def test_vectors_of_a_model_of_any_width(spark):
    """The whole retrieval on vectors of 7 entries, and the nearest rows against numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    from loam.functions import vector as V
    from loam.operators import graph, retrieve, similar

    def encode(texts):
        return np.array([[len(t) % 5 + 1.0, t.count("a"), t.count("e"), t.count("t"), t.count("s"), t.count("n"), 1.0] for t in texts])

    embed = V.model_embed(encode, batch=3)
    docs = spark.createDataFrame([(k, f"Alpha{'abcdefgh'[k]}zz meets Betas{'hgfedcba'[k]}qq at noon. " * 4, "s") for k in range(8)], "doc_id long, text string, source string")
    built = graph.build(docs, embed=embed)
    asked = embed(spark.createDataFrame([(1, "what meets"), (2, None)], "qid long, query string"), "qid", "query", "q")
    assert {len(r.embedding) for r in built.entity.collect()} == {7}
    found = retrieve.Retrieval(asked, built)
    assert found.path.count() == 2 and found.entities.count() > 0
    rows = built.chunk.select("chunk_id", "embedding").collect()
    q = {r.qid: np.array(r.q) for r in asked.collect()}
    got = {(r.qid, r.chunk_id) for r in retrieve.top_chunks(asked, built.chunk, 3).collect()}
    want = set()
    for i, v in q.items():
        score = sorted((-round(float(np.dot(v, r.embedding) / (np.linalg.norm(v) * np.linalg.norm(r.embedding) + 1e-9)), 6), r.chunk_id) for r in rows)
        want |= {(i, c) for _, c in score[:3]}
    assert got == want
    other = spark.createDataFrame([(9, [1.0, 2.0])], "qid long, q array<double>")
    assert retrieve.top_chunks(other, built.chunk).count() == 0  # another width has no cosine
    many = spark.range(9000).select(F.col("id").alias("qid"), F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(7)]).alias("q"))
    assert similar.nearest(built.chunk, many, "chunk_id", 2).groupBy("qid").count().count() == 9000  # several slices


def test_questions_are_numbered_over_files(spark, tmp_path):
    from loam.sources import readers

    for k in range(3):
        (tmp_path / f"q{k}.csv").write_text("query,ground_truth\n" + "".join(f"a{k}{j},b\n" for j in range(4)))
    got = sorted(r.id for r in readers.read_questions(spark, f"{tmp_path}/*.csv").collect())
    assert got == sorted(f"q_{k}" for k in range(1, 13))


def test_unknown_methods_are_refused(spark):
    import pytest

    from loam.operators import graph

    with pytest.raises(ValueError):
        graph.build(spark.createDataFrame([], "doc_id long, text string, source string"), method="unknown")


def test_command_line_pipelines(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in").mkdir()
    for k, (a, b) in enumerate([("Alphaone", "Betatwo"), ("Betatwo", "Gammathree"), ("Gammathree", "Deltafour")]):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{a} meets {b}. {a} leaves {b}.")
    (tmp_path / "q.csv").write_text('id,category,query,ground_truth\n1,factual,What does Alphaone do?,"meets Betatwo"\n2,global,Who meets Deltafour?,Gammathree\n')
    store = str(tmp_path / "store")
    monkeypatch.setattr(cli, "get_spark", lambda app: spark)
    cli.main(["build", str(tmp_path / "in"), store])
    cli.main(["ask", store, "What does Alphaone do?"])
    cli.main(["baseline", store, "What does Alphaone do?"])
    cli.main(["flat", store, "What does Alphaone do?"])
    said = iter(["Who meets Deltafour?", ""])
    monkeypatch.setattr("builtins.input", lambda p: next(said))
    cli.main(["live", store])
    cli.main(["trace", store, "What does Alphaone do?"])
    cli.main(["benchmark", store, str(tmp_path / "q.csv"), "--out", str(tmp_path / "out")])
    out = capsys.readouterr().out
    assert "Entity relationships:" in out and "4 chunks" in out and "Relationships:" in out and "Who meets Deltafour?" in out
    assert "overall" in out and "context_recall" in out and (tmp_path / "out" / "detailed" / "flat").is_dir()


def test_command_line_steps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Alphaone meets Betatwo.")
    (tmp_path / "in" / "b.txt").write_text("Alphaone leaves Betatwo.")
    cli.build(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    prompt = cli.ask(spark, str(tmp_path / "store"), "What does Alphaone do?").first().prompt
    assert "Question: What does Alphaone do?" in prompt and "Alphaone --[" in prompt


def test_errors_of_the_system_are_the_way_and_missing_files_are_not():
    assert [client.kind_of(e) for e in (OSError(), OSError(113, "No route to host"), TimeoutError(), FileNotFoundError("x"), ValueError())] == ["network"] * 3 + ["other"] * 2
