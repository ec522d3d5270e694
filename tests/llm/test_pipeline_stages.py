"""Each stage of the pipeline on all documents of sf0.01, against SQL, brute force or the library: a stage that drops,
repeats or changes a row fails."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import queries, rules
from loam.store import materialize, workspace

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what the last one returns."""
    folder = workspace(spark, "stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.append(materialize(stage(spark, docs[-1], SF), folder, str(k)))
    return docs


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def said(df, sql):
    """DuckDB's rows of ``sql`` with ``df`` as the documents."""
    con = duckdb.connect()
    table = df.select(*COLUMNS).toArrow()
    con.register("documents", table)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_quality_keeps_what_the_base_rule_and_the_list_keep(spark, stages):
    base = {r["doc_id"]: r["base_failed"] for r in said(stages[0], queries.SQL["rule_statistics"])}
    learned = rules.learn_from(stages[0].select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(stages[0].select("doc_id", "text"), learned, prefix="").collect()}
    assert {i: b for i, (b, _) in judged.items()} == base
    assert sorted(rows(stages[1]), key=str) == sorted((r for r in rows(stages[0]) if judged[r[0]][1]), key=str)
    # of good documents few may go by the learned list, of bad ones most must
    quality = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    gone = lambda y: [not judged[i][1] for i, q in quality.items() if q == y and i in judged and not base[i]]
    assert sum(gone(1)) <= 0.02 * len(gone(1)) and sum(not judged[i][1] for i, q in quality.items() if q == 0) > 0.9 * sum(q == 0 for q in quality.values())


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])

    def shingles(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {r[0]: shingles(r[1]) for r in before}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = collections.Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :] if len(own) < 400)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), n in both.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert max(len(own) for own in holders.values()) < 400
    assert sorted(after, key=str) == sorted((r for r in before if find(r[0]) == r[0]), key=str) and len(after) < len(before)


def test_personal_data_goes_and_nothing_else_changes(stages):
    before, after = {r[0]: r for r in rows(stages[2])}, {r[0]: r for r in rows(stages[3])}
    assert before.keys() == after.keys()
    kinds = "kind || ':' || b::bigint || ':' || (b + length(hit))::bigint"
    listed = queries.SQL["pii_base"].replace("sha256(coalesce(listed, '')) as base_sha256", "coalesce(listed, '') as listed")
    assert kinds in listed
    changed = 0
    for r in said(stages[2], listed):
        old, new = before[r["doc_id"]], after[r["doc_id"]]
        assert (old[2], old[3]) == (new[2], new[3]) and new[4] == len(new[1])
        for span in filter(None, r["listed"].split(",")):
            _, b, e = span.split(":")
            assert old[1][int(b) : int(e)] not in new[1]
        if not any(c.isdigit() or c == "@" for c in old[1]):
            assert old[1] == new[1]
        changed += old[1] != new[1]
    assert 0 < changed < len(before) / 2


def test_the_mixture_takes_words_by_source(stages):
    mixed = said(stages[3], queries.SQL["op8_mixing"])
    copies = {r["doc_id"]: r["copies"] for r in mixed}
    want = collections.Counter()
    for r in rows(stages[3]):
        want[r] += copies[r[0]]
    assert collections.Counter(rows(stages[4])) == +want
    # taken words of each source are its target's, but for half a document
    source = {r[0]: r[3] for r in rows(stages[3])}
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in mixed:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target) and len(target) > 5


def test_tokens_are_the_librarys(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r[0]: r[1] for r in rows(stages[4])}
    want = {i: library.encode(t, add_eos=True) for i, t in texts.items()}
    got = stages[5].select("doc_id", "ids", "n_tokens", "spanned_bytes", "round_trip").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows(stages[4]))
    for r in got:
        assert list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) and r.round_trip and r.spanned_bytes == len(texts[r.doc_id].encode())
    assert stages[5].filter(F.col("ids").isNull()).count() == 0
