"""Quality rules: decision lists learned by sequential covering, run as Spark CASE expressions.

Per-document statistics are JVM expressions over the whole text. Learning takes a bounded
sample of labelled rows (``SAMPLE`` rows, chosen by hash of doc_id), turns every threshold
test on a statistic into a bit set over that sample, grows conjunctions for the low-quality
class by information gain on two thirds of the sample and prunes each against the last
third. The ordered rules become one ``CASE WHEN`` column; the default keeps a document.

Defined results: null text has no words and no statistic (all counts 0); it fails the base
rule. Empty label tables, or labels of one class only, give an empty list that keeps all.
Repeated rows are judged alike; other columns pass through ``judge`` untouched, except that the
statistics replace columns of their (prefixed) names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import sampling

# Fixed values of the contract: white space, symbols, window of words, thresholds.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: At most so many labelled rows are read to learn from.
SAMPLE = 4000


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def count_chars(text: Column, chars: str) -> Column:
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(_let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))).cast("long")


def repeated_words(tokens: Column, n: int = WINDOW) -> Column:
    """Words inside windows of 8 words that occur twice or more in the text.

    Windows are hashed by doubling (1, 2, 4, 8 words). Only texts with an equal pair of
    windows take the second step, which finds the union of the windows' positions.
    """
    if n & (n - 1):
        raise ValueError("the window must be a power of two")
    def doubled(width: int):
        return lambda a: F.zip_with(a, F.slice(a, width + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))

    grams, width = F.transform(tokens, lambda w: F.xxhash64(w)), 1
    while width < n:
        grams = _let(grams, doubled(width))
        width *= 2
    windows = F.slice(grams, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            after = F.slice(s, 2, F.size(s))
            paired = F.zip_with(s, after, lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(paired)))

        spans = _let(_let(ranked, starts), lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(n), F.coalesce(y - x, F.lit(n)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(tokens) <= n, F.lit(0)).otherwise(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))).cast("long")


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_upper."""
    whole = F.coalesce(F.col(text), F.lit(""))
    name = lambda x: prefix + x
    out = df.withColumn("loam_rule_tokens", words(F.col(text)))
    tokens = F.col("loam_rule_tokens")
    return out.withColumns(
        {
            name("n_words"): F.size(tokens).cast("long"),
            name("word_chars"): F.length(F.array_join(tokens, "")).cast("long"),
            name("n_symbols"): count_chars(whole, SYMBOLS),
            name("n_dup_lines"): duplicate_lines(whole),
            name("n_repeat_words"): repeated_words(tokens),
            name("n_bangs"): count_chars(whole, "!"),
            name("n_upper"): F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long"),
        }
    ).drop("loam_rule_tokens")


def statistics(text: Column) -> Column:
    """The same statistics as one struct, whose parts are each evaluated once wherever it stands
    (a filter, unlike a projection, does not share what its expressions have in common)."""
    whole = F.coalesce(text, F.lit(""))

    def of(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            count_chars(whole, SYMBOLS).alias("n_symbols"),
            duplicate_lines(whole).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            count_chars(whole, "!").alias("n_bangs"),
            F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        )

    return _let(words(text), of)


#: Numerator and denominator of each statistic that a rule may test.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicates": ("n_dup_lines", "n_words"),
    "bangs": ("n_bangs", "n_words"),
    "upper": ("n_upper", "word_chars"),
}


def _ratio_value(name: str, row) -> float:
    top, bottom = RATIOS[name]
    return float(row[top]) / max(row[bottom], 1) if bottom else float(row[top])


def _ratio_column(name: str, of) -> Column:
    top, bottom = RATIOS[name]
    value = of(top).cast("double")
    return value / F.greatest(of(bottom), F.lit(1)) if bottom else value


def _prefixed(prefix: str):
    return lambda name: F.col(prefix + name)


@dataclass(frozen=True)
class Test:
    statistic: str
    above: bool
    threshold: float

    def column(self, of) -> Column:
        """The test as an expression; ``of`` gives the column of a statistic."""
        value = _ratio_column(self.statistic, of)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    covered: int
    wrong: int

    def __str__(self) -> str:
        return " AND ".join(map(str, self.tests)) + f" -> reject ({self.covered} covered, {self.wrong} wrong)"


def _candidates(rows: list, bins: int) -> dict[Test, int]:
    """Every threshold test with the bit set of the sample rows that pass it."""
    out: dict[Test, int] = {}
    for name in RATIOS:
        values = [_ratio_value(name, r) for r in rows]
        ordered = sorted(set(values))
        step = max(1, len(ordered) // bins)
        cuts = {(a + b) / 2 for a, b in zip(ordered[step - 1 :: step], ordered[step::step], strict=False)}
        for cut in sorted(cuts):
            above = sum(1 << i for i, v in enumerate(values) if v > cut)
            out[Test(name, True, cut)] = above
            out[Test(name, False, cut)] = ((1 << len(rows)) - 1) & ~above
    return out


def learn(rows: list, bins: int = 48, max_rules: int = 8, max_tests: int = 3, min_cover: int = 8, min_precision: float = 0.9) -> list[Rule]:
    """An ordered list of conjunctions that reject, from rows with statistics and ``quality``."""
    rows = sorted((r for r in rows if r["quality"] is not None), key=lambda r: r["doc_id"])
    bad = sum(1 << i for i, r in enumerate(rows) if r["quality"] == 0)
    everyone = (1 << len(rows)) - 1
    if not bad or bad == everyone:
        return []
    tests = _candidates(rows, bins)
    held = sum(1 << i for i in range(0, len(rows), 3))
    rules, left = [], everyone

    def laplace(mask: int) -> float:
        return ((mask & bad).bit_count() + 1) / (mask.bit_count() + 2)

    for _ in range(max_rules):
        mask, chosen = left & ~held, []
        while len(chosen) < max_tests and (p0 := (mask & bad).bit_count()) and p0 < mask.bit_count():
            base = math.log2(p0 / mask.bit_count())
            best = max(
                ((p * (math.log2(p / m.bit_count()) - base), p, str(t), t, m) for t, s in tests.items() if (p := ((m := mask & s) & bad).bit_count()) >= min_cover),
                default=None,
            )
            if best is None or best[0] <= 0:
                break
            chosen.append(best[3])
            mask = best[4]
        # prune the last tests while precision on the held third does not fall
        passes = lambda some: _all(tests, some, left)
        while len(chosen) > 1 and laplace(passes(chosen[:-1]) & held) >= laplace(passes(chosen) & held):
            chosen.pop()
        cover = passes(chosen) if chosen else 0
        wrong = (cover & ~bad).bit_count()
        if cover.bit_count() < min_cover or wrong > (1 - min_precision) * cover.bit_count():
            break
        rules.append(Rule(tuple(chosen), cover.bit_count(), wrong))
        left &= ~cover
        if not left & bad:
            break
    return rules


def _all(tests: dict[Test, int], chosen: list[Test], start: int) -> int:
    for t in chosen:
        start &= tests[t]
    return start


def learn_from(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, the smallest by hash of doc_id. Of clashing
    labels, and of the texts of one doc_id, the smallest counts."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(sampling.smallest(known, ["doc_id"], sample))
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return learn(with_statistics(rows).drop("text").collect())


def verdict(rules: list[Rule], of) -> Column:
    """The 1-based place of the first rule that rejects, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule.tests[0].column(of)
        for t in rule.tests[1:]:
            test = test & t.column(of)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(of) -> Column:
    n, repeated = of("n_words"), of("n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def keeps(text: Column, rules: list[Rule]) -> Column:
    """Whether the base rule and the decision list keep a text, as one expression for a filter."""

    def decide(s: Column) -> Column:
        of = lambda name: s.getField(name)
        return ~base_failed(of) & (verdict(rules, of) == 0)

    return _let(statistics(text), decide)


def judge(df: DataFrame, rules: list[Rule], text: str = "text", prefix: str = "q_") -> DataFrame:
    """``df`` with prefixed statistics, ``base_failed``, ``rule`` and ``kept`` columns."""
    out = with_statistics(df, text, prefix)
    of = _prefixed(prefix)
    out = out.withColumns({prefix + "base_failed": base_failed(of), prefix + "rule": verdict(rules, of)})
    return out.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0))
