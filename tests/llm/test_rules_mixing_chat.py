"""Operators that are Spark expressions throughout, against plain Python."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loam.llm import chat, mixing, rules

DOCS = "/root/testdata/sf0.001/documents.parquet"
SPACED = r"[^\x20\x09-\x0D]+"
ODD = [(-1, None), (-2, ""), (-3, " \n\x0b a"), (-4, "a b c d e f g h " * 2), (-5, "x " * 30), (-6, "l\nl\n\nl \nm"), (-7, "w%d " * 9 % tuple(range(9)) * 2), (-4, "a b c d e f g h " * 2)]


def statistics(text):
    words = re.findall(SPACED, text or "")
    seen = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACED, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    df = spark.read.parquet(DOCS).select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = rules.with_statistics(df).collect()
    assert len(rows) == 200 + len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text), r.doc_id


def test_learned_rules_reject_what_the_labels_call_low(spark):
    docs, labels = spark.read.parquet(DOCS.replace("0.001", "0.01")), spark.read.parquet(DOCS.replace("0.001", "0.01").replace("documents", "labels"))
    learned = rules.learn_from(docs, labels)
    assert learned and all(r.wrong <= 0.1 * r.covered for r in learned)
    judged = rules.judge(docs, learned).join(labels, "doc_id")
    got = {(r.quality, r.kept): r.n for r in judged.groupBy("quality", F.col("q_kept").alias("kept")).agg(F.count("*").alias("n")).collect()}
    assert got[0, False] > 0.85 * (got[0, False] + got.get((0, True), 0))
    base = judged.filter("quality = 1 and q_base_failed").count()
    assert got.get((1, False), 0) - base <= 0.02 * got[1, True]


def test_the_filter_decides_as_the_columns_do(spark):
    docs, labels = spark.read.parquet(DOCS), spark.read.parquet(DOCS.replace("documents", "labels"))
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    learned = rules.learn_from(docs, labels)
    df = docs.select("doc_id", "text").union(odd)
    by_column = sorted(r.doc_id for r in rules.judge(df, learned).filter("q_kept").collect())
    assert by_column == sorted(r.doc_id for r in df.filter(rules.keeps(F.col("text"), learned)).collect())


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert rules.learn_from(docs, none) == []
    assert rules.learn_from(docs, spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")) == []
    assert rules.judge(docs.limit(0), []).count() == 0


def test_judge_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "t", 5)], "doc_id long, text string, tokens string, q_n_words long")
    (r,) = rules.judge(df, []).collect()
    assert r.tokens == "t" and r.q_n_words == 2 and r.q_base_failed


def water(sizes, weights):
    targets, open_ = {}, set(sizes)
    while open_:
        left = sum(sizes.values()) - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return targets | share
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return targets


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix(df, **kw), collections.Counter()


def corpus():
    rows = [(k, "w " * (1 + k * 7 % 23), f"s{k % 6}") for k in range(600)]
    return rows + [(1000, "tiny one", "a"), (1001, None, "a"), (1002, "", None), (1003, "n " * 50, None), (None, "no id", "s1"), (5, rows[5][1], "s5")]


def test_targets_and_taken(spark):
    rows = corpus()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    out, _ = mixed(spark, rows, carry=())
    got = out.collect()
    assert len(got) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-4) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mix_does_not_depend_on_buckets_or_partitions(spark):
    key = lambda df: sorted(map(str, df.select("doc_id", "taken", "first_position").collect()))
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    assert key(mixing.mix(df)) == key(mixing.mix(df.repartition(7), rows=100_000)) == key(mixing.mix(df, rows=1))


def test_curriculum_moves_weight_from_first_to_last_sources(spark):
    out, _ = mixed(spark, [(k, "w w w", f"s{k % 2}") for k in range(4000)])
    rows = mixing.sequence(out.filter("copies > 0")).collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    # weight 1 + tilt * (2t - 1): a source with the higher tilt comes later on average
    mean = {s: sum(r.position for r in rows if r.source == s) / sum(r.source == s for r in rows) for s in ("s0", "s1")}
    assert mean["s0"] > 0.55 and mean["s1"] < 0.45


def test_tokens_are_offsets_in_the_mixed_sequence(spark):
    """A copy's offset is the number of words of all copies before its middle, to a document or so a source."""
    out, _ = mixed(spark, [(k, "w " * (1 + k % 9), f"s{k % 4}") for k in range(3000)])
    rows = mixing.sequence(out.filter("copies > 0")).collect()
    read, whole = 0.0, sum(r.size for r in rows)
    for r in rows:
        assert abs(r.token - (read + r.size / 2)) <= 4 * 9
        read += r.size
    assert [r.token for r in rows] == sorted(r.token for r in rows) and 0 <= rows[0].token and rows[-1].token <= whole + 9


def test_empty_mix(spark):
    assert mixed(spark, [])[0].count() == 0
    (r,) = mixed(spark, [(1, None, None)])[0].collect()
    assert (r.size, r.taken, r.target) == (0, 0, 0.0)


SAID = ["</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST]", "<|turn|>x<|end|>", "<<SYS>> <</SYS>> <s>", "", "plain é\n", "<|im_start|>a<|endoftext|>", "<|\\end|>", "a <"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(s,) for s in SAID], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"(?:<\|(?:turn|text|also|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>)", r.e)


def test_loss_spans_hold_the_assistants_words_and_nothing_else(spark):
    rows = [(1, k, ("user", "assistant", "assistant", "system")[k % 4], s + "\u00e9\U0001f642") for k, s in enumerate(SAID)] + [(2, k, "assistant", f"t{k}") for k in range(300)] + [(3, 0, "user", "no loss"), (4, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).withColumn("texts", chat.loss_texts(F.col("formatted"), F.col("loss"))).collect():
        want = [s for c, _, role, s in rows if c == r.conv_id and role == "assistant"]
        assert r.texts == want
        raw = r.formatted.encode()
        for s, t in zip(r.loss, want, strict=True):
            assert r.formatted[s.begin : s.end] == raw[s.byte_begin : s.byte_end].decode()
            assert r.formatted[: s.begin].endswith((chat.TEXT, chat.ALSO)) and r.formatted[s.end :].startswith((chat.ALSO, chat.END))
            assert len(t) <= s.end - s.begin


def test_tied_turns_sort_by_their_own_text(spark):
    """Not by the escaped one: the backslash sorts behind the bar."""
    texts = ["<|end|>", "<~", "[INST]", "[H", "[J", "</s>", "<0"]
    df = spark.createDataFrame([(1, 0, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(df.repartition(3))).collect()
    assert r.loss_sha256 == hashlib.sha256("".join(sorted(texts)).encode()).hexdigest()


def test_a_conversation_of_many_turns(spark):
    n = 100_000
    turns = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t\u00e9"), F.col("id").cast("string")).alias("text"))
    made = chat.format_conversations(turns)
    (r,) = chat.read_back(made).collect()
    said = "".join(f"t\u00e9{k}" for k in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.n_loss_spans, r.loss_sha256) == (n, len(said), n // 2, hashlib.sha256(said.encode()).hexdigest())


def test_conversations_read_back(spark):
    rows = [(1, k, ("user", "assistant", "assistant", "system")[k % 4], s) for k, s in enumerate(SAID)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 1, "user", "x"), (3, None, "user", "last"), (3, 1, "user", "then")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df.repartition(5))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", s or "") for c, t, role, s in rows if c == conv))
        sha = hashlib.sha256("".join(f"{role}\n{s}\n" for _, role, s in own).encode()).hexdigest()
        loss = "".join(s for _, role, s in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha)
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
