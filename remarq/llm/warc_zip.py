"""Operator 1: WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.csv``, one line per record with its offset and length in the first.
A reader takes the end of the file, follows the ZIP64 locator where there is one, parses the central directory,
finds where the stored members' bytes begin, and then reads any record with one range read.

Writing: equal payloads (by SHA-1 and length) have one response record, that with the largest key; the others are
revisit records that name it. Who revisits whom is found on digests alone, aggregated before they are
shuffled; the page bodies are shuffled once, by page and digest, so a payload that many pages share makes no large task.

Defined cases: a null body is an empty payload, and like any other may have revisits; a null key writes a record
whose id is empty and which is never the one that others revisit (unless no record with that payload has a key, then all are responses);
repeated keys are repeated records, each of which follows the rule for its own payload: of equal keys with
the largest key of a payload all are responses; a null or blank url becomes ``about:blank``; a very long body is one record, held whole by
the task that writes it and by the one that reads it; empty tables give
no archives and no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import csv
import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_folder, open_fs, stored
from .columns import column
from .storage import new_file

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.csv"
#: A revisit record's profile, fixed by the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that a reading task takes with one range read.
SPAN_BYTES = 4 << 20
LEVEL = 1


# --- ZIP directories -------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    offset: int
    size: int


class ZipDirectory:
    """The members of a ZIP file on any random-access file, from its central directory."""

    END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        tail_at = max(0, size - (1 << 16) - 22 - 20)
        tail = file.read_at(size - tail_at, tail_at)
        at = tail.rfind(self.END)
        if at < 0:
            raise ValueError("no ZIP directory")
        entries, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == entries or 0xFFFFFFFF in (length, start):
            locator = at - 20
            if locator < 0 or tail[locator : locator + 4] != self.LOCATOR:
                raise ValueError("no ZIP64 locator")
            record_at = struct.unpack_from("<Q", tail, locator + 8)[0]
            record = file.read_at(56, record_at)
            if record[:4] != self.END64:
                raise ValueError("no ZIP64 directory record")
            entries, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = {m.name: m for m in self._entries(file.read_at(length, start), entries)}

    def _entries(self, data: bytes, entries: int) -> Iterator[Member]:
        at = 0
        for _ in range(entries):
            if data[at : at + 4] != self.ENTRY:
                raise ValueError("damaged ZIP directory")
            method, packed, full, n, extra, comment, offset = struct.unpack_from("<10xH8xIIHHH8xI", data, at)
            name = data[at + 46 : at + 46 + n].decode()
            more = data[at + 46 + n : at + 46 + n + extra]
            if 0xFFFFFFFF in (packed, full, offset):
                packed, full, offset = self._wide(more, packed, full, offset)
            yield Member(name, method, offset, packed)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes, packed: int, full: int, offset: int) -> tuple[int, int, int]:
        """Sizes and offset from the ZIP64 field, which has only those that did not fit, in fixed order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                full, packed, offset = (next(values) if v == 0xFFFFFFFF else v for v in (full, packed, offset))
                return packed, full, offset
            at += 4 + n
        raise ValueError("no ZIP64 field")

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin; its local header says how far after it."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed")
        head = self.file.read_at(30, member.offset)
        if head[:4] != self.LOCAL:
            raise ValueError("damaged ZIP entry")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.offset + 30 + n + extra

    def read(self, name: str) -> bytes:
        return self.file.read_at(self.members[name].size, self.begin(name))


# --- WARC records ----------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the payload's length, and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote((url or "").strip(), safe="%/:=&?~#+!$,;'@()*[]") or "about:blank"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Parsed:
    key: int | None
    url: str
    kind: str
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: int | None


def parse(data: bytes) -> Parsed:
    """A record's fields and payload; a response whose payload is not what its digest says is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return Parsed(_key(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], None if revisit else payload, length, digest, _key(fields["WARC-Refers-To"]) if revisit else None)


def _key(identifier: str) -> int | None:
    text = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


# --- Spark -----------------------------------------------------------------------------------


def _revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """key, digest, n (bytes) and refers_to of the pages that revisit another, from digests alone."""
    marked = pages.where("key is not null").select("key", "digest", "n").where(F.col("n") >= least_bytes)
    groups = marked.groupBy("digest", "n").agg(F.max("key").alias("refers_to"), F.min("key").alias("least")).where("least != refers_to").drop("least")
    return marked.join(groups, ["digest", "n"]).where("key != refers_to").select("key", "digest", "n", "refers_to").distinct()


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC records into ZIP archives; the result, already stored, has a row per archive: uri, n_records, n_bytes.

    Payloads of ``least_bytes`` and more are written once.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    chosen = pages.select(column(key).cast("long").alias("key"), column(url).alias("url"), F.coalesce(column(body), F.lit("")).alias("body"))
    chosen = chosen.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "n": F.octet_length("body")})
    # the join's partitions make the archives; digest and length tell bodies of one key apart, and deal out pages without a key
    dealt = chosen.join(_revisits(chosen, least_bytes), ["key", "digest", "n"], "left").select("key", "url", "body", "refers_to")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for part in parts for r in zip(*(part.column(c) for c in ("key", "url", "body", "refers_to")), strict=True))
        first = next(rows, None)
        if first is None:
            return
        with new_file(folder, "pages.wacz") as (out, uri):
            n_records = _write(out, first, rows)
            n_bytes = out.tell()
        yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n_records, "n_bytes": n_bytes}])

    return stored(dealt.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc-archives")


class _Forward(io.RawIOBase):
    """A stream that can only be written on, so that zipfile puts sizes after the data."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


def _write(out: pa.NativeFile, first: tuple, rows: Iterator[tuple]) -> int:
    index = io.StringIO()
    lines = csv.writer(index, lineterminator="\n")
    n, at = 0, 0
    with zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as archive:
        with archive.open(RECORDS, "w", force_zip64=True) as member:
            row: tuple | None = first
            while row is not None:
                key, url, body, refers_to = (v.as_py() for v in row)
                data = gzip.compress(record(key, url, (body or "").encode(), refers_to), LEVEL, mtime=0)
                member.write(data)
                lines.writerow(("" if key is None else key, at, len(data)))
                at += len(data)
                n += 1
                row = next(rows, None)
        archive.writestr(INDEX, index.getvalue())
    return n


def spans(archives: DataFrame) -> DataFrame:
    """Ranges of records to read: uri, offset, length; from each archive's directories and index alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for uri in part.column(0).to_pylist():
                files, path = open_fs(uri)
                with files.open_input_file(path) as file:
                    directory = ZipDirectory(file)
                    begin = directory.begin(RECORDS)
                    found, at, size = [], 0, 0
                    for _, offset, length in csv.reader(io.StringIO(directory.read(INDEX).decode())):
                        if size and size + int(length) > SPAN_BYTES:
                            found.append({"uri": uri, "offset": begin + at, "length": size})
                            at, size = int(offset), 0
                        size += int(length)
                    found.append({"uri": uri, "offset": begin + at, "length": size})
                yield pa.RecordBatch.from_pylist(found)

    return archives.select("uri").mapInArrow(run, "uri string, offset long, length long")


def records(data: bytes) -> Iterator[bytes]:
    """The gzip members in a range, one record each."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(wbits=31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            chunk = view[at : at + (1 << 14)]
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
        at -= len(unpack.unused_data)
        yield b"".join(parts)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload, null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if with_payload else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for span in part.to_pylist():
                files, path = open_fs(span["uri"])
                with files.open_input_file(path) as file:
                    data = file.read_at(span["length"], span["offset"])
                found = [parse(r) for r in records(data)]
                values = [(r.key, r.payload_bytes, r.digest, r.kind, r.refers_to, r.url, r.payload)[: len(names)] for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), kinds, strict=True)], names=names)

    # as many tasks as there are a few spans for each: adaptive execution would put these small rows, which stand for much reading, into one
    n_tasks = max(1, (archives.agg(F.sum("n_bytes")).first()[0] or 0) // (2 * SPAN_BYTES))
    dealt = spans(archives).repartition(n_tasks, "uri", "offset")
    return dealt.mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives, then read every record back from them."""
    return read_archives(write_archives(pages, key, url, body, least_bytes))
