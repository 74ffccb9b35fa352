"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions over files (small ones together), pushes predicates on record type and headers down, parses headers
first and only then decides whether a payload is decoded at all. Records that this module writes are gzip members that carry
their compressed length in an extra field, so what isn't wanted is skipped without inflating it; other members are inflated
to find their end, plain archives are skipped by Content-Length. Payloads that are read are digested again.

Paths are read and written with Arrow's file systems: whatever both Python and Spark reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import scratch_path, written

#: Fixed values of the WARC 1.1 standard.
VERSION, REVISIT = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a new archive is begun, and bytes of archives that one task reads.
ROLL, TASK = 256 << 20, 64 << 20
#: Records in an Arrow batch: so many, or as soon as they hold so many payload bytes.
ROWS, BYTES = 512, 8 << 20

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, page_id long, refers_to long, payload_bytes long, headers map<string,string>, intact boolean, payload binary"
_FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, payload_digest: str | None = None) -> bytes:
    """One record as a gzip member: a response with HTTP headers and payload, or a revisit with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    known = payload_digest or digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{known}")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{known}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        head["WARC-Target-URI"] = _uri(url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:x-page:{refers_to}>", "X-Refers-To-Page-Id": str(refers_to)}
    block = http + payload if refers_to is None else http
    head["Content-Length"] = str(len(block))
    record = (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    press = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 4, 255) + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Source:
    """Bytes of a file from a place on, read in blocks."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.kept, self.size = file, block, b"", file.size()

    def tell(self) -> int:
        return self.file.tell() - len(self.kept)

    def more(self) -> bytes:
        got, self.kept = self.kept, b""
        return got or self.file.read(self.block)

    def give_back(self, rest: bytes) -> None:
        self.kept = rest + self.kept

    def peek(self, n: int) -> bytes:
        while len(self.kept) < n and (got := self.file.read(max(self.block, n))):
            self.kept += got
        return self.kept[:n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.kept = self.kept[n:]
        return got

    def skip(self, n: int) -> None:
        if n <= len(self.kept):
            self.kept = self.kept[n:]
        else:
            self.file.seek(self.tell() + n)
            self.kept = b""


def _parse(raw: bytes) -> dict[str, str]:
    """Header lines to a map with lower-case names; folded lines are joined, the last of a repeated name counts."""
    out, last = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class _Inflated:
    """What is in a gzip member, with what goes on in the members after it, as a source of its own."""

    def __init__(self, source: _Source):
        self.source, self.inflate, self.kept = source, zlib.decompressobj(31), b""

    def _fill(self, on: bool) -> bool:
        """Inflates a little more, of the next member too if `on`. False at the end."""
        if self.inflate.eof:
            if not on or self.source.peek(2) != b"\x1f\x8b":
                return False
            self.inflate = zlib.decompressobj(31)
        piece = self.inflate.unconsumed_tail or self.source.more()
        if not piece:
            return False
        self.kept += self.inflate.decompress(piece, 1 << 20)
        if self.inflate.eof:
            self.source.give_back(self.inflate.unused_data)
        return True

    def peek(self, n: int) -> bytes:
        while len(self.kept) < n and self._fill(True):
            pass
        return self.kept[:n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.kept = self.kept[n:]
        return got

    def skip(self, n: int) -> None:
        while n > len(self.kept):
            n -= len(self.kept)
            self.kept = b""
            if not self._fill(True):
                return
        self.kept = self.kept[n:]

    def ended(self) -> bool:
        """Whether the member has nothing more than line ends; the next one isn't begun."""
        while True:
            while len(self.kept) < 2 and self._fill(False):
                pass
            if self.kept[:2] != b"\r\n":
                return not self.kept.strip()
            self.kept = self.kept[2:]


def _own_member(source: _Source, wanted, payload: bool):
    """The record of a member that carries its lengths, as (headers, block or None): found is None if it isn't wanted.

    Returns (True, found), or (False, None) with the source where it was if the member isn't one record of that length."""
    start, extra = source.tell(), source.peek(24)
    known, size = struct.unpack("<II", extra[16:24])
    inflate, got = zlib.decompressobj(31), bytearray()

    def to(place: int) -> None:
        if place >= source.tell():
            source.skip(place - source.tell())
        else:
            source.file.seek(place)
            source.kept = b""

    # Headers first: a little at a time until they are whole.
    while b"\r\n\r\n" not in got and not inflate.eof:
        piece = inflate.unconsumed_tail or source.take(4096)
        if not piece:
            break
        got += inflate.decompress(piece, 4096)
    end = got.find(b"\r\n\r\n")
    headers = _parse(bytes(got[: end + 4])) if end >= 0 else {}
    n = int(headers.get("content-length", "0") or 0)
    if end < 0 or size != (end + 4 + n + 4) & 0xFFFFFFFF:
        to(start)
        return False, None
    keep = wanted(headers)
    if not keep or not payload and _http_end(got, end, headers) >= 0:
        to(start + known)
        return True, (headers, bytes(got[end + 4 :])) if keep else None
    while not inflate.eof:
        piece = inflate.unconsumed_tail or source.more()
        if not piece:
            break
        got += inflate.decompress(piece, 1 << 20)
    to(start + known)
    return True, (headers, bytes(got[end + 4 : end + 4 + n]))


def _members(source: _Source, wanted, payload: bool):
    """The wanted records of the next gzip member, of which there may be many."""
    extra = source.peek(24)
    if extra[3:4] == b"\x04" and extra[12:14] == b"sl" and len(extra) == 24:
        one, found = _own_member(source, wanted, payload)
        if one:
            if found:
                yield found
            return
    inside = _Inflated(source)
    while not inside.ended():
        found = _plain(inside, wanted, payload)
        if found:
            yield found


def _http_end(got: bytes, end: int, headers: dict) -> int:
    """Where the HTTP headers end in the block, -1 while unknown; 0 for a block without any."""
    if "http" not in headers.get("content-type", ""):
        return 0
    return got.find(b"\r\n\r\n", end + 4)


def _plain(source: _Source, wanted, payload: bool):
    while source.peek(2) == b"\r\n":
        source.skip(2)
    n = 1 << 10
    while b"\r\n\r\n" not in (head := source.peek(n)):
        if len(head) < n:
            source.skip(len(head))  # trailing bytes that are no record
            return None
        n *= 2
    end = head.index(b"\r\n\r\n") + 4
    headers = _parse(source.take(end))
    size = int(headers.get("content-length", "0") or 0)
    if not wanted(headers):
        source.skip(size)
        return None
    block = source.take(size if payload else min(size, 4096))
    while len(block) < size and _http_end(block, -4, headers) < 0:
        piece = source.take(min(size - len(block), len(block)))
        if not piece:
            break
        block += piece
    source.skip(size - len(block))
    return headers, block


def records(file, wanted=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the wanted records of an open archive: all records of plain archives and of gzip members, however many
    a member holds or how members cut them. Without `payload`, blocks may be cut after their headers."""
    source = _Source(file)
    while len(start := source.peek(4)) >= 2:
        if start[:2] == b"\x1f\x8b":
            yield from _members(source, wanted, payload)
        elif found := _plain(source, wanted, payload):
            yield found


def _row(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    row = {name: headers.get(key) for name, key in _FIELDS.items()}
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    for name in ("page_id", "refers_to"):
        row[name] = int(row[name]) if row[name] else None
    size, body = int(headers.get("content-length", "0") or 0), block
    if "http" in headers.get("content-type", ""):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            http, body = _parse(block[: end + 4]), block[end + 4 :]
            size = int(http.get("content-length", size - end - 4))
    row["payload_bytes"] = size
    row["payload"] = body if payload and row["record_type"] != "revisit" else None
    row["intact"] = None
    if row["payload"] is not None and row["record_type"] == "response":
        # What is returned is the digest of what was read; the header's stays in `headers`.
        claimed, row["payload_digest"] = row["payload_digest"], digest(body)
        row["intact"] = len(body) == size and (claimed is None or claimed == row["payload_digest"])
    row["headers"] = list(headers.items())
    return row


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Takes comparisons of record type, page ids and other header fields; hands the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            key = f.attribute[1] if len(getattr(f, "attribute", ())) == 2 and f.attribute[0] == "headers" else _FIELDS.get(name)
            number = name in ("page_id", "refers_to")
            if key and isinstance(f, In):
                self.tests.append((key, number, "in", tuple(f.value)))
            elif key and isinstance(f, IsNotNull):
                self.tests.append((key, number, "there", None))
            elif key and type(f) in _COMPARE:
                self.tests.append((key, number, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _files(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
            done = [i for i in found if i.base_name == "_COMMITTED"]
            if done:  # written here: only what the job committed counts
                with system.open_input_stream(done[0].path) as file:
                    names = set(json.loads(file.read()))
                found = [i for i in found if i.base_name in names]
            found = [i for i in found if i.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [Files()], 0
        for i in sorted(found, key=lambda i: i.path):
            if out[-1].paths and size + i.size > TASK:
                out.append(Files())
                size = 0
            out[-1].paths.append(i.path)
            size += i.size
        return out

    def read(self, partition):
        tests = [(key, number, {k.__name__: v for k, v in _COMPARE.items()}.get(kind, kind), value) for key, number, kind, value in self.tests]

        def wanted(headers: dict[str, str]) -> bool:
            for key, number, test, value in tests:
                own = headers.get(key)
                if own is None:
                    return False
                own = int(own) if number else own.removeprefix("sha1:") if key == "warc-payload-digest" else own
                if test == "in" and own not in value or callable(test) and not test(own, value):
                    return False
            return True

        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if not self.payload:
            names.remove("payload")

        def batch(rows):
            return pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        system, _ = _files(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, block in records(file, wanted, self.payload):
                    rows.append(_row(headers, block, self.payload))
                    size += len(block)
                    if len(rows) >= ROWS or size >= BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Committed(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator):
        """Archives with names of their own for each attempt; only those of committed tasks are listed at the end."""
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = encode_record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"], self.date, row.get("payload_digest"))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Committed(names)

    def commit(self, messages):
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_COMMITTED", compression=None) as file:
            file.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages):
        system, root = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """format("warc"): options path, payload ("false" leaves the column out and payloads undecoded), date (of written records).

    payload_digest is that of the payload as it was read, where it was, and the header's elsewhere; intact says whether the two and
    the length agree (null where no payload was read)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA if self.options.get("payload", "true") != "false" else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session and lets Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row. Of equal payloads of at least `least` bytes, the one with the largest id is the response
    and the others revisit it; smaller payloads are all responses.

    A null html is an empty payload, a null url leaves the target out. A null id counts as the smallest: such a row revisits a
    row with an id, and is a response if there is none. Rows that repeat the largest id are all responses. Digests decide
    equality (SHA-1 of the payload). An empty table writes an archive list without archives. Other columns are ignored.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("hex"))
    # Groups of equal payloads by digest alone, summed before they are shuffled; only those with more than one row come back.
    equal = rows.filter(F.octet_length("payload") >= least).groupBy("hex").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("hex", "first")
    equal = written(equal, "equal-payloads")
    out = rows.join(equal, "hex", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    out.write.format("warc").option("path", path).option("date", date).mode("append").save()


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as archives in the shared folder, read back: all columns of format("warc"), payloads decoded."""
    path = scratch_path(pages.sparkSession, "archives")
    write_warc(pages, path, least, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_warc(pages.sparkSession, path)
