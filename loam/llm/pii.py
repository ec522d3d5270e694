"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of one pattern a kind with its test
(octets, Luhn, digit counts); each scanner is linear in the text. The model reads windows of
tokens around those digits and ``@`` that no base span holds. A segment of up to
``ENTITY_TOKENS`` tokens is scored as a whole: its length, digit groups, character classes, checks
(Luhn, octets) and its neighbours. Dynamic programming over segments and types finds the best
labelling of a window, boundaries and types jointly; forward-backward over the same lattice gives
the gradient in training.

Training needs no labels: entities of each kind and look-alikes (versions, years, counts) are
generated from a seed and put between words of a bounded sample of documents: the whole texts of the
``CARRIERS`` documents with the smallest hashes.
Segments that touch a base span are no candidates. Added kind ``secret``: keys and tokens.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive;
other columns pass through; an empty table gives no rows. Whole texts are read, in time that is
linear in a text and its spans; memory is bounded by a batch and the longest text.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm import sampling, textkit

KINDS = ("email", "ip", "card", "phone", "secret")
ENTITY_TOKENS = 14
#: Characters that a window takes in on either side of a digit or ``@``.
REACH = 80
#: Candidates hold an ``@``, so many digits, or a run of letters and digits so long.
LEAST_DIGITS, MOST_DIGITS, LONG_TOKEN = 7, 80, 12
CARRIERS = 200
EXAMPLES = 700
EPOCHS = 5

# Fixed values of the contract: the base patterns, from their rarest character on.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_REST = re.compile(r"[^\W_]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    finders = (emails, ips, cards, phones)
    return [(kind, b, e) for kind, find in zip(KINDS, finders, strict=False) for b, e in find(text)]


def segment_features(text: str, begin: int, end: int, tokens: int) -> list[str]:
    """What the model sees of ``text[begin:end]`` as one entity."""
    s = text[begin:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    n, plain = len(digits), s.replace(" ", "").replace("-", "")
    left, right = text[begin - 1 : begin], text[end : end + 1]
    out = [
        "bias",
        f"tokens{min(tokens, 10)}",
        f"digits{0 if n == 0 else 1 if n < 4 else 2 if n < 9 else 3 if n < 13 else 4 if n < 20 else 5}",
        f"length{0 if len(s) < 7 else 1 if len(s) < 12 else 2 if len(s) < 16 else 3 if len(s) < 24 else 4}",
        f"ratio{int(3.99 * n / len(s))}",
        f"dots{min(s.count('.'), 4)}",
        "leftglue" if left.isalnum() else "leftfree",
        "rightglue" if right.isalnum() else "rightfree",
    ]
    if left in "=:\"'" and left:
        out.append("assigned")
    if " " in s:
        out.append("blank")
        if letters and n:
            out.append("worded")
    if s[0] == "+":
        out.append("plus")
    if s[0] == "(" or ("(" in s) != (")" in s):
        out.append("open")
    if "@" in s:
        out.append("at")
        if re.fullmatch(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)+", s):
            out.append("address")
    if n and not letters:
        if all(c in "0123456789 -" for c in s):
            out.append("groups")
            if 13 <= n <= 19:
                out.append("luhn" if luhn(digits) else "notluhn")
        if all(c in "0123456789 +().-" for c in s) and 9 <= n <= 15:
            out.append("dialled")
        parts = s.split(".")
        if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
            out.append("octets" if all(map(_octet, parts)) else "notoctets")
    if n and letters and plain.isalnum() and tokens == 1:
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(plain, plain[1:], strict=False))
        out.append(f"mixed{min(changes // 3, 3)}")
        if all(c in "0123456789abcdef" for c in plain.lower()):
            out.append("hex")
        if plain.isupper():
            out.append("capitals")
        if len(plain) >= 14:
            out.append("longkey")
    return out


@dataclass
class Model:
    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS), 0)))
    change: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def segments(self, text: str, window: np.ndarray, free=lambda b, e: True) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
        """For each token that may begin an entity: (one past the last token, feature ids) of the
        candidates. They hold an ``@``, digits of an entity's number or a long run of letters and
        digits, cross no line, begin and end like an entity and are ``free``."""
        begins, ends = (array("i", window[:, k].tobytes()) for k in (0, 1))
        hot = [text[b] == "@" or any("0" <= x <= "9" for x in text[b:e]) for b, e in zip(begins, ends, strict=True)]
        n, ahead = len(begins), -1
        for i in range(n):
            ahead = max(ahead, i)
            while ahead < n and not hot[ahead]:
                ahead += 1
            if ahead >= i + ENTITY_TOKENS or ahead == n:
                continue
            b = begins[i]
            if not (text[b].isalnum() or text[b] in "+("):
                continue
            out, at, digits, longest = [], False, 0, 0
            for j in range(i, min(i + ENTITY_TOKENS, n)):
                tb, te = begins[j], ends[j]
                if j > i and (tb - ends[j - 1] > 1 or text[ends[j - 1] : tb] in ("\n", "\r", "\t")):
                    break
                if hot[j]:
                    at = at or text[tb] == "@"
                    digits += sum("0" <= x <= "9" for x in text[tb:te])
                    longest = max(longest, te - tb)
                if digits > MOST_DIGITS or not free(b, te):
                    break
                if (at or digits >= LEAST_DIGITS or longest >= LONG_TOKEN) and text[te - 1].isalnum():
                    names = segment_features(text, b, te, j - i + 1)
                    out.append((j + 1, [k for x in names if (k := self.names.get(x)) is not None]))
            if out:
                yield i, out

    def lattice(self, text: str, window: np.ndarray) -> list[tuple[int, int, list[int]]]:
        return [(i, j, ids) for i, found in self.segments(text, window) for j, ids in found]

    def best(self, text: str, window: np.ndarray, free=lambda b, e: True) -> list[tuple[str, int, int]]:
        """The entities of the best labelling of a window.

        Scores are kept for the last ``ENTITY_TOKENS`` places only; what stays of each place is
        where its best labelling comes from, some bytes a token."""
        n, none, span = len(window), len(KINDS), ENTITY_TOKENS + 1
        value = np.full((span, none + 1), -np.inf)  # of place j in row j modulo the span
        value[0, none] = 0
        steps, froms = np.ones((n + 1, none + 1), np.uint8), np.full((n + 1, none + 1), none, np.uint8)
        found = self.segments(text, window, free)
        start, here = next(found, (n, []))
        if start == n:
            return []
        for i in range(n):
            now = value[i % span]
            reach = now + self.change[:, none]
            after = value[(i + 1) % span]
            if (total := reach.max()) > after[none]:
                after[none], steps[i + 1, none], froms[i + 1, none] = total, 1, reach.argmax()
            if start == i:
                moved = now[:, None] + self.change[:, :none]
                top, reach = moved.argmax(0), moved.max(0)
                for j, ids in here:
                    total, later = reach + self.weights[:, ids].sum(1), value[j % span]
                    for kind in np.flatnonzero(total > later[:none]).tolist():
                        later[kind], steps[j, kind], froms[j, kind] = total[kind], j - i, top[kind]
                start, here = next(found, (n, []))
            now[:] = -np.inf
        out, j, state = [], n, int(value[n % span].argmax())
        while j:
            i = j - int(steps[j, state])
            if state != none:
                out.append((KINDS[state], int(window[i][0]), int(window[j - 1][1])))
            j, state = i, int(froms[j, state])
        return out[::-1]


def windows(text: str, spots: list[int]) -> Iterator[np.ndarray]:
    """Tokens (begin, end) of disjoint stretches of ``text`` around the given places, in order."""
    done, k = 0, 0
    while k < len(spots):
        lo, hi = max(done, spots[k] - REACH), min(len(text), spots[k] + REACH)
        while lo > done and text[lo - 1].isalnum() and text[lo].isalnum():
            lo -= 1
        while True:
            while k < len(spots) and spots[k] - REACH <= hi:
                hi = max(hi, min(len(text), spots[k] + REACH))
                k += 1
            if hi < len(text) and text[hi - 1].isalnum():
                hi = _REST.match(text, hi).end()
            if k == len(spots) or spots[k] - REACH > hi:
                break
        done = hi
        flat = array("i", chain.from_iterable(m.span() for m in _TOKEN.finditer(text, lo, hi)))
        if flat:
            yield np.frombuffer(flat, np.int32).reshape(-1, 2)


def added_spans(model: Model, text: str, base: list[tuple[str, int, int]], spots: list[int]) -> list[tuple[str, int, int]]:
    """Spans of the model that touch no base span."""
    begins: list[int] = []  # the base spans as disjoint stretches
    ends: list[int] = []
    for b, e in sorted((b, e) for _, b, e in base):
        if ends and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(b)
            ends.append(e)

    def free(b: int, e: int) -> bool:
        k = bisect_right(begins, e - 1) - 1
        return k < 0 or ends[k] <= b

    if begins:
        spots = [at for at in spots if free(at, at + 1)]
    out = [found for window in windows(text, spots) for found in model.best(text, window, free)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


# ---- training ----


def _entity(rng: random.Random, kind: str) -> tuple[str, str, str]:
    """Text before, entity, text after."""
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name = rng.choice([word(3, 8), f"{word(2, 6)}.{word(2, 6)}", f"{word(3, 6)}.{rng.randint(1, 99)}", f"{word(3, 6)}_{number(2)}"])
        return "", f"{name}@{word(3, 8)}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'example.com', 'net', 'co.uk'])}", ""
    if kind == "ip":
        return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), ""
    if kind == "card":
        digits = rng.choice("3456") + number(14)
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        return "", rng.choice([digits, " ".join(digits[k : k + 4] for k in range(0, 16, 4)), "-".join(digits[k : k + 4] for k in range(0, 16, 4))]), ""
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return "", rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(2, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{rng.randint(20, 99)}{a}{b}{c}"]), ""
    if kind == "secret":
        if rng.random() < 0.25:  # keys with the mark of who gave them out
            mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(20, 36))) + rng.choice("0123456789") + rng.choice("abcdef")
            return "", rng.choice(["ghp_", "sk-", "pk_live_", "xoxb-", ""]) + mixed, ""
        hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + rng.choice("0123456789") + rng.choice("abcdef")
        capital = rng.choice(["AKIA", "ASIA", ""]) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(14)) + rng.choice("234567") + rng.choice("ABCDEF")
        name = rng.choice(["password", "token", "secret", "key", "api_key", "pwd"])
        if rng.random() < 0.15:
            hexes = lambda n, lower=hexes: lower(n).upper()
        return rng.choice([("", capital, ""), (f"{name}=", hexes(rng.choice([16, 18, 20, 24])), ""), (f'{name} = "', hexes(rng.choice([32, 40, 64])), '"'), (f"{name}: ", hexes(32), "")])
    if rng.random() < 0.3:  # as many digits as a card, but the check digit is wrong
        digits = number(rng.choice([13, 14, 15, 16, 16, 16, 17, 18, 19]))
        digits += next(c for c in "0123456789" if not luhn(digits + c)) if len(digits) < 19 else ""
        return "", digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10), ""
    decoy = rng.choice(
        [
            f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", str(rng.randint(1900, 2030)), str(rng.randint(1, 999)),
            f"{rng.randint(1, 9)},{number(3)}", f"{rng.randint(1, 99)} {rng.randint(1, 99)}", f"{word(3, 6)}{rng.randint(1, 99)}", f"{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{rng.randint(256, 999)}.{number(3)}.{rng.randint(300, 999)}.{number(2)}", f"@{word(4, 9)}", f"{rng.randint(10, 99)}%",
            number(rng.randint(5, 8)), number(rng.randint(20, 30)), f"{rng.randint(1, 23)}:{rng.randint(10, 59)}",
            rng.choice([" ", ", ", ",", "; "]).join(str(rng.randint(0, rng.choice([9, 99, 999]))) for _ in range(rng.randint(5, 12))),
            ",".join(f'{{"{word(1, 5)}":{rng.randint(0, 999)},"{word(1, 3)}":{rng.randint(0, 99999)}}}' for _ in range(rng.randint(1, 3))),
            f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
            f"{word(1, 4)}={rng.randint(0, 9999)}&{word(1, 4)}={rng.randint(0, 9999)}", f"{word(10, 16)}{rng.randint(1, 99)}",
        ]
    )
    return "", decoy, ""


def examples(carriers: list[str], n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = random.Random(seed)
    words = [t.split() or ["a"] for t in carriers] or [["the", "of", "and"]]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.choice([1, 1, 2])):
            source = rng.choice(words)
            at = rng.randrange(len(source))
            text += " ".join(w for w in source[at : at + rng.randint(2, 5)] if not any(c.isdigit() or c == "@" for c in w)) + " "
            kind = rng.choice([*KINDS, "none", "none"])
            before, entity, after = _entity(rng, kind)
            text += before
            if kind != "none":
                gold.append((kind, len(text), len(text) + len(entity)))
            text += entity + after + rng.choice(["", "", ".", ","]) + rng.choice([" ", " ", "\n"])
        out.append((text + " ".join(rng.choice(words)[:2]), gold))
    return out


def fit(carriers: list[str], n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Conditional maximum likelihood by stochastic gradient over generated examples."""
    data = examples(sorted(carriers), n, seed)
    model, prepared = Model(), []
    none = len(KINDS)
    for text, gold in data:
        for window in windows(text, [k for k, c in enumerate(text) if "0" <= c <= "9" or c == "@"]):
            for i in range(len(window)):  # names of all features first
                if text[window[i][0]].isalnum() or text[window[i][0]] in "+(":
                    for j in range(i, min(i + ENTITY_TOKENS, len(window))):
                        for x in segment_features(text, window[i][0], window[j][1], j - i + 1):
                            model.names.setdefault(x, len(model.names))
            prepared.append((text, window, gold))
    model.weights = np.zeros((none, len(model.names)))
    lattices = [(t, w, g, model.lattice(t, w)) for t, w, g in prepared]
    squares, change_squares = np.full_like(model.weights, 1e-6), np.full_like(model.change, 1e-6)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(lattices)
        for _text, window, gold, segments in lattices:
            n_tokens = len(window)
            scores = [model.weights[:, ids].sum(1) for _, _, ids in segments]
            ending: dict[int, list[int]] = {}
            for k, (_, j, _) in enumerate(segments):
                ending.setdefault(j, []).append(k)
            ahead = np.full((n_tokens + 1, none + 1), -np.inf)
            ahead[0, none] = 0
            for j in range(1, n_tokens + 1):
                ahead[j, none] = np.logaddexp.reduce(ahead[j - 1] + model.change[:, none])
                for k in ending.get(j, ()):
                    into = np.logaddexp.reduce(ahead[segments[k][0]][:, None] + model.change[:, :none], axis=0) + scores[k]
                    ahead[j, :none] = np.logaddexp(ahead[j, :none], into)
            whole = np.logaddexp.reduce(ahead[n_tokens])
            behind = np.full((n_tokens + 1, none + 1), -np.inf)
            behind[n_tokens] = 0
            g_w, g_c = np.zeros_like(model.weights), np.zeros_like(model.change)
            starting: dict[int, list[int]] = {}
            for k, (i, _, _) in enumerate(segments):
                starting.setdefault(i, []).append(k)
            for i in range(n_tokens - 1, -1, -1):
                step = model.change[:, none] + behind[i + 1, none]
                g_c[:, none] -= np.exp(np.clip(ahead[i] + step - whole, -50, 0))
                total = step
                for k in starting.get(i, ()):
                    move = model.change[:, :none] + (scores[k] + behind[segments[k][1], :none])[None, :]
                    p = np.exp(np.clip(ahead[i][:, None] + move - whole, -50, 0))
                    g_c[:, :none] -= p
                    g_w[:, segments[k][2]] -= p.sum(0)[:, None]
                    total = np.logaddexp(total, np.logaddexp.reduce(move, axis=1))
                behind[i] = total
            place = {(window[i][0], window[j - 1][1]): (i, j, ids) for i, j, ids in segments}
            truth = {place[b, e][0]: (KINDS.index(kind), *place[b, e][1:]) for kind, b, e in gold if (b, e) in place}
            at, state = 0, none
            while at < n_tokens:
                kind, to, ids = truth.get(at, (none, at + 1, ()))
                g_c[state, kind] += 1
                if kind != none:
                    np.add.at(g_w[kind], list(ids), 1)
                at, state = to, kind
            for part, grad, sq in ((model.weights, g_w, squares), (model.change, g_c, change_squares)):
                grad -= 1e-3 * part
                sq += grad * grad
                part += 0.4 * grad / np.sqrt(sq)
    return model


def fit_from(documents: DataFrame, carriers: int = CARRIERS) -> Model:
    """Learn with words of ``carriers`` documents, the smallest by hash of doc_id and text."""
    texts = documents.filter("text is not null and text <> ''").select("doc_id", F.col("text").alias("t"))
    return fit([r.t for r in sampling.smallest(texts, ["doc_id", "t"], carriers).collect()])


# ---- Spark ----

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def batch_spans(model: Model, column: pa.Array) -> Iterator[tuple[int, str, list[tuple[str, int, int, bool]]]]:
    """Row, text and spans of the texts of a column that hold a digit or ``@``; no others have spans."""
    data, offsets = textkit.string_bytes(column)
    spots = np.flatnonzero(_TRIGGER[data])
    owner = np.searchsorted(offsets, spots, "right") - 1
    rows, first = np.unique(owner, return_index=True)
    if not len(rows):
        return
    for d, lo, hi in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(spots)], strict=True):
        raw = data[offsets[d] : offsets[d + 1]]
        whole = raw.tobytes().decode(errors="replace")
        at = spots[lo:hi] - offsets[d]
        if len(whole) != len(raw):
            at = (np.cumsum((raw & 0xC0) != 0x80) - 1)[at]
        base = base_spans(whole)
        found = [(*s, True) for s in base] + [(*s, False) for s in added_spans(model, whole, base, at.tolist())]
        yield d, whole, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with ``spans`` (kind, begin, end, base), by kind as listed, then begin."""
    df = df.drop(*(c for c in ("spans",) if c != text))  # the results replace columns of their names
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    textkit.bound_batches(spark)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, _, found in batch_spans(shared.value, batch.column(batch.schema.get_field_index(text))):
                spans[d] = [{"kind": k, "begin": b, "end": e, "base": x} for k, b, e, x in found]
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind; texts without spans stay as they are."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    textkit.bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            changed = {d: masked(whole, [s[:3] for s in found]) for d, whole, found in batch_spans(shared.value, batch.column(place)) if found}
            if changed:
                values = batch.column(place).to_pylist()
                for d, value in changed.items():
                    values[d] = value
                batch = batch.set_column(place, text, pa.array(values, batch.column(place).type))
            yield batch

    return df.mapInArrow(run, df.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each maximal run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            out += [text[at:b], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
