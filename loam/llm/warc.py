"""WARC archives: writing, a normaliser for monolithic gzip, and reading by an offset index.

``write_archives`` packs pages into archives that are, as badly made crawls are, one gzip stream
from end to end. ``normalise`` inflates such a stream once, front to back, rewrites every record
as a gzip member of its own and writes a sidecar index (offset, length, type, record id, URI,
digest per line). ``read_archives`` goes through the index and inflates single members.

Of pages with equal payloads the one with the smallest page_id is a response; the others are
revisits, which carry the response's headers and digest but no payload. Which is which is
settled on digests and ids alone, so no html is sent around for it; only the list of revisits
meets the pages again (broadcast by Spark where it is small, else joined on its own ids).

Files go to the shared folder through Arrow's file systems, under a name of their own for each
attempt of a task; only those that a finished task lists are ever read.

Defined results: null html is an empty payload; a null page_id is always a response and refers
to nothing; rows that repeat the smallest page_id of a payload are all responses; a null url is
left out; extra columns are not read; an empty table writes no archive and returns no rows. A
record must fit in memory, an archive need not.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import textkit
from loam.llm.store import materialize, workspace

#: Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def digest_column(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, made of four groups of 40 bits."""
    hexes = F.sha1(payload)
    group = lambda k: F.lpad(F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*map(group, range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, with the blank lines behind it."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:none>"), ("WARC-Date", DATE)]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)))
    lines.append(("WARC-Payload-Digest", "sha1:" + digest(payload)))
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(lines) + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one member or of many, piece by piece."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            out = inflater.decompress(data, READ_BYTES)
            if out:
                yield out
            if inflater.eof:
                data, inflater = inflater.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            else:
                data = inflater.unconsumed_tail
    if rest := inflater.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, whole record, block) of each record of a stream."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        seen = 0
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a header")
                return
        if held[:1] in (b"\r", b"\n"):
            continue
        fields = parse_header(bytes(held[:at]))
        end = at + 4 + int(fields["content-length"])
        while len(held) < end:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[:end]), bytes(held[at + 4 : end])
        del held[:end]


def _located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    system, path = _located(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        out = deflater = name = None
        size = n = 0

        def close() -> pa.RecordBatch:
            out.write(deflater.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                    deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
                whole = record(page_id, url, (html or "").encode(), refers_to)
                out.write(deflater.compress(whole))
                size, n = size + len(whole), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                source, at = _located(archive)
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with (
                    source.open_input_stream(at, compression=None) as stream,
                    system.open_output_stream(f"{path}/{name}", compression=None) as out,
                    system.open_output_stream(f"{path}/{name}.idx", compression=None) as index,
                ):
                    for fields, whole, _ in records(inflated(stream)):
                        deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflater.compress(whole + b"\r\n\r\n") + deflater.flush()
                        out.write(member)
                        index.write("\t".join([str(offset), str(len(member)), fields["warc-type"], fields["warc-record-id"], fields.get("warc-payload-digest", "-"), fields.get("warc-target-uri", "-")]).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, member_offset long, member_length long"


def _page(urn: str | None) -> int | None:
    found = _PAGE.fullmatch(urn or "")
    return int(found[1]) if found else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for archive in batch.column(0).to_pylist():
            source, at = _located(archive)
            rows: list[tuple] = []
            with source.open_input_stream(f"{at}.idx", compression=None) as f:
                index = f.read().decode().splitlines()
            with source.open_input_file(at) as members:
                for line in index:
                    offset, length = map(int, line.split("\t")[:2])
                    members.seek(offset)
                    whole = zlib.decompress(members.read(length), 31)
                    head, _, rest = whole.partition(b"\r\n\r\n")
                    fields = parse_header(head)
                    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                    said = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    sum_ = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != said or digest(payload) != sum_):
                        raise ValueError(f"{archive} at {offset}: the payload is not the one written")
                    rows.append((_page(fields["warc-record-id"]), said, sum_, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), offset, length))
                    if len(rows) >= 4096:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)


def find_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload a smaller page_id has."""
    light = pages.select("page_id", digest_column(F.coalesce("html", F.lit("")).cast("binary")).alias("payload_digest")).filter("page_id is not null")
    firsts = light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("payload_digest").alias("d"), "refers_to")
    return light.join(firsts, F.col("payload_digest") == F.col("d")).filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(archive, n_records) of the monolithic archives of (page_id, url, html)."""
    revisits = materialize(find_revisits(pages), folder, "revisits").withColumnRenamed("page_id", "revisit_id").withColumnRenamed("payload_digest", "d")
    own = digest_column(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html")
    if not revisits.isEmpty():
        keyed = rows.withColumn("payload_digest", own)
        rows = keyed.join(revisits, (F.col("page_id") == F.col("revisit_id")) & (F.col("payload_digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    textkit.bound_batches(pages.sparkSession)
    return materialize(rows.mapInArrow(_writer(f"{folder}/monolithic"), "archive string, n_records long"), folder, "written")


def _apart(archives: DataFrame, keep: str = "archive") -> DataFrame:
    """Archives dealt over tasks, as many to each: by ranges of their names, which are random."""
    parts = max(1, min(10_000, archives.count()))
    return archives.select(keep).repartitionByRange(parts, keep)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, n_records) of the archives rewritten to one member a record, each with its ``.idx``."""
    return materialize(_apart(archives).mapInArrow(_normaliser(f"{folder}/normalised"), "archive string, n_records long"), folder, "indexed")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of normalised archives, read member by member through their indexes."""
    return _apart(archives).mapInArrow(_reader, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = workspace(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(pages, folder), folder))
