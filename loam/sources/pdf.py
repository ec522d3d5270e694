"""Text of simple PDF files, with the standard library alone.

Reads the content streams of the pages (plain or deflated) in the order of the file and takes what
their text operators show, in one-byte encodings; a move to another line is a line break. Files with
composite fonts, other filters or encryption need an extractor of their own.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_CONTENTS = re.compile(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
# strings in parentheses or as hex, the operators that show them, and those that begin a line
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[jJdDm*]|\bET\b|['\"]|\[|\]", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def one(m: re.Match) -> bytes:
        if m[1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.DOTALL).decode("cp1252", "replace")


def _page_text(content: bytes) -> str:
    out: list[str] = []
    held: list[str] = []
    for m in _SHOWN.finditer(content):
        token = m.group()
        if token[:1] in b"(<":
            held.append(_string(token))
        elif token in (b"Tj", b"TJ"):
            out += held
            held = []
        elif token in (b"'", b'"'):
            out += ["\n", *held]
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            held = []
            if out and not out[-1].endswith("\n"):
                out.append("\n")
    return "".join(out)


def pages(data: bytes) -> list[str]:
    """The text of each page: an ``Extractor`` for the readers."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}

    def content(number: int) -> bytes:
        m = _STREAM.match(objects.get(number, b""))
        if not m:
            return b""
        if b"/FlateDecode" not in m[1]:
            return m[2]
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error as e:
            raise ValueError(f"object {number} of the file cannot be inflated: {e}") from e

    out = []
    for body in objects.values():
        if re.search(rb"/Type\s*/Page\b", body) and (m := _CONTENTS.search(body)):
            out.append(_page_text(b"\n".join(content(int(n)) for n in _REFERENCE.findall(m[1]))))
    if not out and re.search(rb"/ObjStm\b|/Encrypt\b", data):
        raise ValueError("the file keeps its objects in streams, or encrypted; give an extractor that reads such files")
    return out
