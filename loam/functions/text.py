"""String semantics of the pipeline as Column functions, all of them JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
_BLANK = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def strip(text: Column) -> Column:
    # only the ends are looked at; a pattern would be tried at every blank of the text
    return F.btrim(text, F.lit(_BLANK))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def windows(text: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Raw overlapping slices; a size or overlap of 0 falls back to the default."""
    size, overlap = size or 1500, overlap or 150
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.substring(text, p + 1, F.lit(size)))


def chunks(text: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Stripped, non-empty slices; a chunk's index counts only those kept."""
    return F.filter(F.transform(windows(text, size, overlap), strip), lambda c: c != "")


def short_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def cache_key(path: Column) -> Column:
    return F.concat(F.lit("extraction_"), F.substring(F.md5(path), 1, 10), F.lit(".json"))


def title(text: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the rest."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def one(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(run, F.lit(2))))

    return F.array_join(F.transform(runs, one), "")


def entity_name(raw: Column) -> Column:
    # most names are one plain word, which has no blanks and one run of letters
    word = F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substr(raw, F.lit(2))))
    return F.when(F.regexp_like(raw, F.lit(r"^[A-Za-z]+\z")), word).otherwise(title(strip(raw)))


def canonical_key(name: Column) -> Column:
    """Articles (each once, in this order), parentheses and punctuation go; blanks collapse."""
    # one plain word has none of these
    return F.when(F.regexp_like(name, F.lit(r"^[A-Za-z0-9]+\z")), F.lower(name)).otherwise(_canonical(name))


def _canonical(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    for article in ("the ", "a ", "an "):
        key = F.regexp_replace(key, f"^{article}", "")
    key = F.regexp_replace(key, r"\s*\(.*?\)\s*", " ")
    key = F.regexp_replace(key, "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def better_description(a: Column, b: Column) -> Column:
    """The one that contains the other, else the longer, else the first."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return (
        F.when(a == "", b).when(b == "", a)
        .when(F.contains(F.lower(b), F.lower(a)), b)
        .when(F.contains(F.lower(a), F.lower(b)), a)
        .when(F.length(a) >= F.length(b), a).otherwise(b)
    )


def relation_type(raw: Column) -> Column:
    clean = F.regexp_replace(F.upper(F.coalesce(raw, F.lit("RELATED_TO"))), "[^A-Z0-9_]", "_")
    return F.when(clean == "", F.lit("RELATED_TO")).otherwise(clean)


def shown_relation(kind: Column) -> Column:
    return F.lower(F.replace(kind, F.lit("_"), F.lit(" ")))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def reply_json(reply: Column) -> Column:
    """The JSON text of a model's reply: of the first fence, whole, or between the outermost
    brackets, then braces; ``{}`` where none of these parses."""
    fence = r"(?s)```(?:json)?\s*\n?(.*?)```"
    body = strip(F.when(F.regexp_like(reply, F.lit(fence)), F.regexp_extract(reply, fence, 1)).otherwise(reply))
    whole = lambda x: F.try_parse_json(x).isNotNull()

    def between(opening: str, closing: str) -> Column:
        first = F.instr(body, opening)
        last = F.length(body) - F.instr(F.reverse(body), closing) + 1
        return F.when((first > 0) & F.contains(body, F.lit(closing)) & (last > first), F.substring(body, first, last - first + 1))

    array, object_ = between("[", "]"), between("{", "}")
    return F.when(whole(body), body).when(whole(array), array).when(whole(object_), object_).otherwise(F.lit("{}"))


def detected_source(text: Column) -> Column:
    """The first of the first three lines that is a title: over 10 characters, no parenthesis."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), strip)
    titles = F.filter(lines, lambda x: (F.length(x) > 10) & ~F.startswith(x, F.lit("(")))
    return F.coalesce(F.substring(F.try_element_at(titles, F.lit(1)), 1, 80), F.lit("unknown"))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.try_cast("double")))


def preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def bar(score: Column, width: int = 30) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(score * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))


def path_step(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" --["), kind, F.lit("]--> "), target)


def joined_chunks(texts: Column, limit: int | None = 1200) -> Column:
    shown = F.transform(texts, lambda t: preview(t, limit)) if limit else texts
    return F.array_join(shown, "\n\n---\n\n")


def fallback_summary(summary: Column, members: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.concat(F.lit("Community covering: "), F.substring(members, 1, 200)))


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` characters, broken at blanks where possible."""
    return strip(F.regexp_replace(text, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"))
