"""Collocations: frequent phrases by contiguous pattern growth, scored by how their parts attract.

Pieces of text are sequences of words; only what stands side by side counts. For every word the
occurrences are projected: each is a pointer to the words that follow it in its piece, as far as a
phrase reaches, and equal ones of a slice of texts are merged with their number before they are
shuffled. All pointers of a prefix meet in one task, which sorts them and extends the prefix to the
right, depth first, as long as it stays frequent: an extension's pointers are a stretch of its
prefix's. Words that make up more than ``1 / HOT`` of all words (so ``HOT`` of them at most) are dealt
to several tasks by the word that follows; what is extended is then still whole in one task. A prefix
whose pointers exceed ``HELD`` bytes is counted in portions, which are given out unpruned and summed.

A phrase is cut after each of its words but the last; the cut with the lowest score counts. Numbers are
exact: products are decimals of 38 digits, enough for counts up to 10^15.

Defined results: a null text is empty, a null language ``und``; a text without a word adds nothing; repeated
rows count as often as they stand there; a language's number of words counts all, frequent or not; equal
scores go by count, then by phrase in byte order; an empty table gives no rows; other columns are not
read. One text is held as a whole by a task, in arrays of some eight times its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import textkit
from loam.llm.store import materialize, workspace

LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: A longer phrase with so many per cent of a phrase's occurrences stands for it.
COVERED = 50
HOT = 1000
#: Bytes of text that are projected at once, and of pointers that are grown at once.
SLICE = HELD = 8 << 20
#: In how many parts a language is ranked before its best phrases meet.
PARTS = 16

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _ENDS.copy()
_GAPS[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pooled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The batches in tables of about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Slice:
    """The words of some texts: a dictionary, and a code and piece for each occurrence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        data = _LOWER[data]
        inside = ~_GAPS[data]
        starts, ends, doc = textkit.word_bounds(data, offsets, inside)
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        kind = (pa.string(), np.int32) if at[-1] < 1 << 31 else (pa.large_string(), np.int64)
        words = pa.Array.from_buffers(kind[0], len(starts), [None, pa.py_buffer(at.astype(kind[1])), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words, self.code = words.dictionary, words.indices.to_numpy().astype(np.int64)
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy().astype(np.int64)[doc]
        # pieces are numbered through; a new text begins a new one as well
        self.piece = np.cumsum(_ENDS[data])[starts] + doc if len(starts) else starts

    def counted(self) -> pa.RecordBatch:
        n = max(1, len(self.words))
        key, count = np.unique(self.lang * n + self.code, return_counts=True)
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(key // n)), self.words.take(pa.array(key % n)).cast(pa.string()), pa.array(count)], names=["lang", "word", "n"])

    def blocks(self, hot: list[tuple[str, str, int]]) -> tuple[np.ndarray, int]:
        """The block of each occurrence's next word, for occurrences of hot words, and one more than the largest."""
        out, most = np.zeros(len(self.code), np.int64), 1
        if not hot or not len(self.code):
            return out, most
        lang = {v: k for k, v in enumerate(self.langs.to_pylist())}
        word = pc.index_in(pa.array([w for _, w, _ in hot]), self.words.cast(pa.string())).to_pylist()
        n = len(self.words)
        many = np.ones(max(1, len(self.langs)) * n, np.int64)
        for (name, _, blocks), code in zip(hot, word, strict=True):
            if code is not None and name in lang:
                many[lang[name] * n + code] = blocks
        data, at = textkit.string_bytes(self.words)
        hashes = textkit.word_hashes(data, at[:-1], at[1:]) >> np.uint64(1)
        after = np.r_[self.code[1:], 0]
        of = many[self.lang * n + self.code]
        return hashes.astype(np.int64)[after] % of, int(many.max())

    def projected(self, most_words: int, hot: list[tuple[str, str, int]]) -> pa.RecordBatch | None:
        """A row a prefix: the words that follow it, each distinct run once, and how often each stands there."""
        n, size = len(self.code), len(self.words) + 1
        none = size - 1
        after = []
        for k in range(1, most_words):
            there = np.zeros(n, bool)
            there[: max(0, n - k)] = self.piece[k:] == self.piece[: max(0, n - k)]
            after.append(np.where(there, np.r_[self.code[k:], np.zeros(min(k, n), np.int64)], none))
        some = np.flatnonzero(after[0] != none) if n else np.zeros(0, np.int64)
        if not len(some):
            return None
        block, most = self.blocks(hot)
        prefix = (self.lang * size + self.code) * most + block
        key = prefix[some]
        for column in after:
            if int(key.max()) >= (1 << 62) // size:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + column[some]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        first = some[first]
        own = prefix[first]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[starts[1:], len(own)]
        parts = [self.words.take(pa.array(column[first], mask=column[first] == none)).cast(pa.string()) for column in after]
        tails = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(own)].astype(np.int32)), tails), "\n")
        bounds = (np.r_[starts, len(own)] * 4).astype(np.int32)
        counts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(times.astype("<i4"))])
        head = first[starts]
        weight = np.add.reduceat(times, starts)
        assert len(ends) == len(weight)
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[head])), self.words.take(pa.array(self.code[head])).cast(pa.string()), pa.array(block[head].astype(np.int32)), tails, counts],
            names=["lang", "word", "blk", "tails", "times"],
        )


def _over_slices(docs: DataFrame, schema: str, work: Callable[[_Slice], pa.RecordBatch | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pooled(batches, SLICE):
            data, offsets = textkit.string_bytes(table.column("text").combine_chunks())
            langs = table.column("lang").combine_chunks()
            for lo, hi in textkit.slices(offsets, SLICE):
                out = work(_Slice(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], langs.slice(lo, hi - lo)))
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)


class _Grower:
    """Phrases that the pointers of whole prefixes give, grown to the right from each prefix."""

    def __init__(self, table: pa.Table, least: int, depth: int):
        lang, word, blk = (table.column(c).combine_chunks() for c in ("lang", "word", "blk"))
        codes = [lang.dictionary_encode().indices.to_numpy(), word.dictionary_encode().indices.to_numpy(), blk.to_numpy()]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]
        self.heads, self.lang, self.word = np.flatnonzero(new), lang, word
        listed = pc.split_pattern(table.column("tails").combine_chunks(), "\n")
        prefix = np.repeat(np.cumsum(new) - 1, pc.list_value_length(listed).to_numpy())
        split = pc.split_pattern(listed.flatten(), " ")
        width = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        self.words, code = words.dictionary, words.indices.to_numpy()
        begin = np.cumsum(width) - width
        # the words that follow, -1 where a piece ends
        self.after = [np.where(width > k, code[np.minimum(begin + k, max(0, len(code) - 1))], -1) for k in range(depth)]
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<i4").astype(np.int64)
        order = np.lexsort((*reversed(self.after), prefix))
        self.after, self.prefix, times = [c[order] for c in self.after], prefix[order], times[order]
        self.before = np.r_[0, np.cumsum(times)]  # so a stretch of pointers counts as a difference
        self.least, self.depth = least, depth
        self.found: list[tuple[int, int, int, int]] = []  # of a phrase: a pointer, its words after the prefix, its count

    def _runs(self, column: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of equal values from lo to hi that are frequent enough: starts, ends, counts."""
        part = column[lo:hi]
        starts = np.r_[lo, np.flatnonzero(part[1:] != part[:-1]) + lo + 1]
        ends = np.r_[starts[1:], hi]
        count = self.before[ends] - self.before[starts]
        enough = count >= self.least
        return starts[enough], ends[enough], count[enough]

    def grow(self, lo: int, hi: int, depth: int) -> None:
        """Extend the prefix of the pointers from lo to hi by each frequent next word, each in turn to its end."""
        column = self.after[depth]
        starts, ends, count = self._runs(column, lo, hi)
        for a, b, n in zip(starts.tolist(), ends.tolist(), count.tolist(), strict=True):
            if column[a] >= 0:
                self.found.append((a, depth + 1, n))
                if depth + 1 < self.depth and b > a:
                    self.grow(a, b, depth + 1)

    def phrases(self) -> pa.RecordBatch:
        if len(self.prefix):
            for a, b, _ in zip(*self._runs(self.prefix, 0, len(self.prefix)), strict=True):
                self.grow(int(a), int(b), 0)
        at, long, count = (np.array([f[k] for f in self.found], np.int64) for k in range(3))
        head = pa.array(self.heads[self.prefix[at]])
        parts = [self.word.take(head)]
        parts += [self.words.take(pa.array(column[at], mask=long <= k)) for k, column in enumerate(self.after)]
        phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
        return pa.RecordBatch.from_arrays([self.lang.take(head), phrase, pa.array(count)], names=["lang", "phrase", "n"])


def _grown(pointers: DataFrame, least: int, most_words: int, held_bytes: int) -> DataFrame:
    """(lang, phrase, n) of two words or more, of pointers that stand together by prefix."""
    keys = ("lang", "word", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, portion = 0, None  # portion: the prefix of which a part has been given out

        def told(parts: list[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
            if parts:
                out = _Grower(pa.Table.from_batches(parts), threshold, most_words - 1).phrases()
                if out.num_rows:
                    yield out

        for batch in batches:
            # a batch's rows, cut where their pointers would be more than is held
            row_bytes = np.cumsum(pc.binary_length(batch.column("tails")).to_numpy().astype(np.int64) * 2)
            cuts = np.unique(np.searchsorted(row_bytes, np.arange(held_bytes, int(row_bytes[-1]) + 1, held_bytes), "right")) if len(row_bytes) else []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo >= hi:
                    continue
                part = batch.slice(lo, hi - lo)
                held.append(part)
                size += int(row_bytes[hi - 1] - (row_bytes[lo - 1] if lo else 0))
                if size < held_bytes:
                    continue
                # the last prefix may go on; what stands before it is whole
                table = pa.Table.from_batches(held)
                last = tuple(table.column(c)[-1].as_py() for c in keys)
                same = np.ones(table.num_rows, bool)
                for c, v in zip(keys, last, strict=True):
                    same &= pc.equal(table.column(c), pa.scalar(v, table.schema.field(c).type)).to_numpy(zero_copy_only=False)
                begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                whole, rest = table.slice(0, begin).combine_chunks().to_batches(), table.slice(begin).combine_chunks().to_batches()
                if portion is not None and begin:
                    # the rows of the prefix in portions come first
                    first = _length_of(table, keys, portion)
                    yield from told(table.slice(0, first).combine_chunks().to_batches() if first else [], 1)
                    whole = table.slice(first, begin - first).combine_chunks().to_batches()
                    portion = None
                yield from told(whole, least)
                rest_bytes = sum(int(pc.sum(pc.binary_length(r.column("tails"))).as_py() or 0) * 2 for r in rest)
                if rest_bytes >= held_bytes:
                    yield from told(rest, 1)
                    portion, held, size = last, [], 0
                else:
                    held, size = rest, rest_bytes
        if held:
            table = pa.Table.from_batches(held)
            first = _length_of(table, keys, portion) if portion is not None else 0
            yield from told(table.slice(0, first).combine_chunks().to_batches() if first else [], 1)
            yield from told(table.slice(first).combine_chunks().to_batches() if first < table.num_rows else [], least)

    dealt = pointers.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "lang string, phrase string, n long")


def _length_of(table: pa.Table, keys: tuple[str, ...], value: tuple) -> int:
    """How many rows at the start have this key."""
    same = np.ones(table.num_rows, bool)
    for c, v in zip(keys, value, strict=True):
        same &= pc.equal(table.column(c), pa.scalar(v, table.schema.field(c).type)).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~same)
    return int(other[0]) if len(other) else table.num_rows


def _parts(first: str, last: str):
    return F.array_join(F.slice("w", F.expr(first), F.expr(last)), " ")


def frequent(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, held_bytes: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of the phrases of one to ``most_words`` words that stand there ``least`` times or
    more, and (lang, n) of all words."""
    spark = docs.sparkSession
    textkit.bound_batches(spark)
    folder = workspace(spark, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text <> ''")
    words = _over_slices(rows, "lang string, word string, n long", _Slice.counted).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, folder, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    # at most HOT rows: each is over 1 / HOT of all words
    many = words.filter(F.col("n") * HOT > total).select("lang", "word", F.ceil(F.col("n") * HOT / F.lit(max(1, total))).cast("int"))
    hot = [tuple(r) for r in many.collect()]
    pointers = _over_slices(rows, "lang string, word string, blk int, tails string, times binary", lambda s: s.projected(most_words, hot))
    grown = _grown(pointers, least, most_words, held_bytes).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = words.select("lang", F.col("word").alias("phrase"), "n").unionByName(grown).filter(F.col("n") >= least)
    return materialize(found, folder, "found"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, covered: int = COVERED, held_bytes: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of (text, lang)."""
    found, totals = frequent(docs, least, most_words, held_bytes)
    candidates = found.withColumn("w", F.split("phrase", " ")).filter(F.size("w") > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", _parts("1", "k").alias("head"), _parts("k + 1", "size(w) - k").alias("tail"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(found.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    long = lambda c: f"cast({c} as decimal(18, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({long('a')} * {long('a')} * 1000000) div ({long('l')} * {long('r')})"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest)
    # inside longer ones
    inner = candidates.filter(F.size("w") > 2).withColumn("m", F.explode(F.expr("sequence(2, size(w) - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size(w) - m + 1)")))
    inner = inner.select("lang", _parts("at", "m").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for keys in (("lang", "part"), ("lang",)):  # so that a language's phrases never meet in one task
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
