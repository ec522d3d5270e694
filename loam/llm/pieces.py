"""SentencePiece encoding that keeps, for every piece, the bytes of the source it came from.

``Normalizer`` replays the model's normalisation: at each place the longest prefix found in
the compiled character map is replaced, any other character is copied, then white space is
escaped. It records for every normalised byte the source byte that it came from. ``Segmenter``
merges the normalised text by the model's pieces, best score first and leftmost among equals;
what no piece holds becomes byte pieces. The pieces' lengths in normalised bytes, summed up, point
into the alignment and give the source span of each piece. The lengths must add up to the
normalised text, which is checked for every document. Decoding joins the pieces' bytes.

Where no piece of the model goes on past the blank that ends a word, words are merged apart,
many side by side, and the pieces of ``REMEMBERED`` or so short words are kept at hand. The library is not called: it
is what the tests hold ids and decoded texts against.

Defined results: null and empty text give the end id alone, with an empty span; a model must be of
the BPE kind with byte pieces, and without pieces of its user (any other raises). Other columns
pass through. Memory is bounded by a batch and the longest text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loam.llm import textkit

BLANK = "▁"
SPACE = BLANK.encode()
REMEMBERED = 250_000
#: Words of more characters are not kept at hand, and are merged one by one with a heap.
SHORT = 40
# Fixed values of the format: the kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Normalizer:
    """Normalisation of a model with the alignment of its output to its input."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True, suffix: bool = False):
        self.dummy_prefix, self.remove_extra, self.escape, self.suffix = dummy_prefix, remove_extra, escape, suffix
        self.units, self.strings = None, b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
            self.strings = charsmap[4 + size :]

    @classmethod
    def of(cls, model: bytes) -> Normalizer:
        top = [(k, v) for k, v in _fields(model) if k in (2, 3)]
        spec = dict(x for k, v in top if k == 3 for x in _fields(v))
        trainer = dict(x for k, v in top if k == 2 for x in _fields(v))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)))

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at ``at``, and its replacement."""
        if self.units is None:
            return None
        units, found = self.units, None
        node = self._child(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._child(units[node])
            if leaf:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) its place in ``data``."""
        if self.units is None and not self.remove_extra and not self.suffix:
            return self._copy(data)
        return self._replace(data)

    def _copy(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape else b" "
        source = np.frombuffer(data, np.uint8)
        width = np.where(source == 32, len(space), 1) if self.escape else np.ones(len(source), np.int64)
        align = np.append(np.repeat(np.arange(len(source), dtype=np.int32), width), np.int32(len(source)))
        out = data.replace(b" ", space)
        if self.dummy_prefix and data:
            return space + out, np.concatenate([np.zeros(len(space), np.int32), align])
        return out, align

    def _replace(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape else b" "
        bits: list[tuple[bytes, int, bool]] = []  # normalised bytes, place in the source, whether copied
        at = 0
        while at < len(data):
            hit = self.longest_prefix(data, at)
            copied = hit is None
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
                try:
                    data[at : at + n].decode()
                    hit, copied = ((n, data[at : at + n]), True) if n else ((1, "\ufffd".encode()), False)
                except UnicodeDecodeError:
                    hit, copied = (1, "\ufffd".encode()), False
            bits.append((hit[1], at, copied))
            at += hit[0]
        if self.remove_extra:  # no blanks at either end, none behind another
            kept: list[tuple[bytes, int, bool]] = []
            for text, place, copied in bits:
                if not kept or kept[-1][0].endswith(b" "):
                    text = text.lstrip(b" ")
                if text:
                    kept.append((text, place, copied))
            while kept and not kept[-1][0].rstrip(b" "):
                kept.pop()
            if kept:
                kept[-1] = (kept[-1][0].rstrip(b" "), *kept[-1][1:])
            bits = kept
        if self.dummy_prefix and bits:
            bits = [*bits, (b" ", len(data), False)] if self.suffix else [(b" ", bits[0][1], False), *bits]
        out = [(text.replace(b" ", space), place, copied and text != b" ") for text, place, copied in bits]
        # a copied character keeps the places of its own bytes
        align = [place + np.arange(len(text)) if copied else np.full(len(text), place) for text, place, copied in out]
        return b"".join(text for text, _, _ in out), np.concatenate([*align, [len(data)]]).astype(np.int32)


class Segmenter:
    """Byte-pair merges of normalised text by the scores of a model's pieces."""

    def __init__(self, pieces: list[tuple[bytes, float, int]]):
        self.ids, self.score, self.byte = {}, {}, {}
        for k, (piece, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                self.ids[piece.decode()], self.score[piece.decode()] = k, score
            elif kind == BYTE:
                self.byte[int(piece[1:-1], 16)] = k
            elif kind not in (UNKNOWN, CONTROL):
                raise ValueError(f"pieces of kind {kind} are not supported")
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        # control characters that no piece holds stand alone: nothing merges with them
        alone = "".join(f"\\x{c:02x}" for c in range(32) if not any(chr(c) in p for p in self.ids))
        some = f"[{alone}]|" if alone else ""
        self.words = re.compile(f"{some}{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" if apart else r"(?s:.+)").findall
        self.known: dict[str, bytes] = {}  # 32-bit ids
        self._tables()

    def _tables(self) -> None:
        """Symbols (pieces, and characters of pieces) as numbers, and what two of them make."""
        symbols = list(self.ids)
        symbols += sorted({c for p in symbols for c in p} - set(symbols))
        number = {p: k for k, p in enumerate(symbols)}
        self.piece_of = np.array([self.ids.get(p, -1) for p in symbols], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
        ranks = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.wide = len(symbols)
        pairs = sorted((number[p[:k]] * self.wide + number[p[k:]], ranks[x], number[p]) for p, x in self.score.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair, self.rank, self.whole = (np.array([r[c] for r in pairs], np.int64) for c in range(3))
        self.none = len(ranks)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 32 bits each. Words seen before are looked up, the others merged
        side by side."""
        split = [self.words(t) for t in texts]
        seen = set().union(*split)
        new = seen - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: x for w, x in self.known.items() if w in seen}
        short = [w for w in new if len(w) <= SHORT]
        self.known.update(zip(short, self.merged_short(short), strict=True))
        long_ = [w for w in new if len(w) > SHORT]
        self.known.update((w, self.merged(w)) for w in long_)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in long_:
            del self.known[w]
        return out

    def merged_short(self, words: list[str]) -> list[bytes]:
        """``merged`` of many words at once: each round makes the best merge of every word."""
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(words)), length)
        rank, whole = self._pairs(symbol[:-1], symbol[1:])
        rank, whole = np.append(rank, self.none), np.append(whole, -1)
        rank[np.cumsum(length) - 1] = self.none
        done = []
        while len(symbol):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            more = np.repeat(least < self.none, size)
            done.append((owner[~more], symbol[~more]))
            if not more.any():
                break
            least = np.repeat(least, size)[more]
            symbol, owner, rank, whole = symbol[more], owner[more], rank[more], whole[more]
            at = np.flatnonzero(rank == least)
            at = at[np.diff(owner[at], prepend=-1) > 0]  # the leftmost of each word
            symbol[at] = whole[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            ends = np.append(owner[1:] != owner[:-1], True)[at + 1]
            at = at - np.arange(len(at))  # places once the second symbols are gone
            symbol, owner, rank, whole = symbol[keep], owner[keep], rank[keep], whole[keep]
            right = at[~ends]
            rank[at[ends]] = self.none
            rank[right], whole[right] = self._pairs(symbol[right], symbol[right + 1])
            left = at[(at > 0)]
            left = left[owner[left - 1] == owner[left]] - 1
            rank[left], whole[left] = self._pairs(symbol[left], symbol[left + 1])
        owner, symbol = (np.concatenate([d[c] for d in done]) for c in range(2))
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        ids = np.where(symbol >= 0, self.piece_of[symbol], -1)
        ends = np.searchsorted(owner, np.arange(len(words)), "right").tolist()
        flat, lo, out = ids.astype(np.int32).tobytes(), 0, []
        for hi in ends:
            out.append(flat[4 * lo : 4 * hi])
            lo = hi
        for k in np.unique(owner[ids < 0]).tolist():  # characters that no piece is: bytes
            out[k] = self.merged(words[k])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what two symbols make; the last rank where they make nothing."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], self.none), np.where(hit, self.whole[at], -1)

    def merged(self, word: str) -> bytes:
        out = []
        for part in self._merged_parts(list(word)):
            k = self.ids.get(part)
            out += [k] if k is not None else [self.byte[b] for b in part.encode()]
        return np.array(out, np.int32).tobytes()

    def _merged_parts(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(k: int) -> tuple[float, int, str] | None:
            whole = parts[k] + parts[after[k]]
            score = self.score.get(whole)
            return None if score is None else (-score, k, whole)

        heap = [x for k in range(n - 1) if (x := pair(k))]
        heapify(heap)
        while heap:
            _, k, whole = heappop(heap)
            if not parts[k] or after[k] == n or parts[k] + parts[after[k]] != whole:
                continue  # one of the two has been merged since
            gone = after[k]
            parts[k], parts[gone] = whole, ""
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                if x := pair(k):
                    heappush(heap, x)
            if before[k] >= 0 and (x := pair(before[k])):
                heappush(heap, x)
        return [p for p in parts if p]


class Encoder:
    def __init__(self, model: bytes):
        self.normalizer = Normalizer.of(model)
        pieces, trainer = [], {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece.get(1, b""), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer |= dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("the model is of another kind than BPE")
        self.segment = Segmenter(pieces)
        self.end = next(k for k, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == trainer.get(47, b"</s>"))
        self.lengths = np.array([{NORMAL: len(p), BYTE: 1}.get(kind, 0) for p, _, kind in pieces], np.int64)
        self.surface = [{NORMAL: p.replace(SPACE, b" "), BYTE: bytes([int(p[1:-1], 16)]) if kind == BYTE else b"", UNKNOWN: " \u2047 ".encode()}.get(kind, b"") for p, _, kind in pieces]
        n = self.normalizer
        self.plain = n.units is None and n.dummy_prefix and n.escape and not n.remove_extra and not n.suffix

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """All ids (an end id closes each text), the texts' n + 1 offsets into them, the source
        bytes [begin, end) of each id, and the decoded texts."""
        if self.plain:
            normal = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        else:
            both = [self.normalizer(t.encode()) for t in texts]
            normal = [x.decode() for x, _ in both]
        last = np.array([self.end], np.int32).tobytes()
        found = [x + last for x in self.segment(normal)]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int64)
        ids = np.frombuffer(b"".join(found), np.int32)
        if self.plain:
            begins, ends = self._plain_spans(texts, ids, offsets)
        else:
            spans = [self.spans(*pair, ids[lo:hi]) for pair, lo, hi in zip(both, offsets, offsets[1:], strict=False)]
            begins, ends = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in spans)]) for k in (0, 1))
        return ids, offsets.astype(np.int32), begins.astype(np.int32), ends.astype(np.int32), [self.decode(np.frombuffer(x, np.int32).tolist()) for x in found]

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.surface.__getitem__, ids))
        n = self.normalizer
        if (n.dummy_prefix or n.remove_extra) and not n.suffix and ids and self.surface[ids[0]].startswith(b" "):
            whole = whole[1:]  # the blank that the model puts first
        return whole.decode(errors="replace")

    def _plain_spans(self, texts: list[str], ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``spans`` of many texts at once where the character map is empty."""
        data = [t.encode() for t in texts]
        limits = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        source = np.frombuffer(b"".join(data), np.uint8)
        width = np.where(source == 32, len(SPACE), 1)
        width[limits[:-1][np.diff(limits) > 0]] += len(SPACE)  # the blank that the model puts first
        align = np.append(np.repeat(np.arange(len(source), dtype=np.int32), width), np.int32(len(source)))
        ends = np.cumsum(self.lengths[ids])
        normal = np.concatenate([[0], np.cumsum(width)])[limits[1:]]
        if (ends[offsets[1:] - 1] != normal).any():
            raise ValueError("the pieces of a text do not add up to its normalised text")
        shift = np.repeat(limits[:-1], np.diff(offsets))
        return align[ends - self.lengths[ids]] - shift, align[ends] - shift

    def spans(self, normal: bytes, align: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes [begin, end) of each id, from the normalised text and its alignment."""
        width = self.lengths[ids]
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError(f"the pieces hold {ends[-1]} bytes, the normalised text {len(normal)}")
        return align[ends - width], align[ends]


@lru_cache(2)
def encoder(model_path: str) -> Encoder:
    with open(model_path, "rb") as f:
        return Encoder(f.read())


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with ids, begins, ends (source bytes) and decoded."""
    import pyspark.sql.types as T

    df = df.drop(*(c for c in ("ids", "begins", "ends", "decoded") if c != text))  # the results replace columns of their names
    carried = [f for f in df.schema.fields if f.name != text]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*carried, T.StructField("ids", ints), T.StructField("begins", ints), T.StructField("ends", ints), T.StructField("decoded", T.StringType())])
    textkit.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids, offsets, begins, ends, decoded = own.batch(texts)
            join = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != text]
            columns += [join(ids), join(begins), join(ends), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)
