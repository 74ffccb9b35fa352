import gzip
import hashlib
import base64
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querysmith.llm import warc

PAGES = [(1, "http://a/1", "<p>same</p>", 9), (2, "http://a/2", "<p>same</p>", 9), (3, "http://b/\r\nX: y", "é" * 100, 1), (4, None, None, None), (5, "http://c", "", 2), (None, "http://d", "<p>same</p>", 3), (6, "http://e", "x" * 300_000, 1), (7, "http://f", "lone", 1)]
SHAPE = "page_id long, url string, html string, refers_to int"


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, SHAPE).repartition(3)
    rows = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(rows) == len(PAGES)
    for key, url, html, _ in PAGES:
        raw = (html or "").encode()
        equal = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        r = rows[key]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if key == max(equal) else ("revisit", max(equal)))
        assert r.payload == (raw if r.record_type == "response" else None)
        assert (r.target_uri is None) == (url is None)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_payloads_are_responses(spark):
    rows = warc.round_trip(spark.createDataFrame(PAGES, SHAPE), least=50).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_largest_id_twice(spark):
    rows = warc.round_trip(spark.createDataFrame([(2, "u", "h", 0), (2, "u", "h", 0), (1, "u", "h", 0)], SHAPE)).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(1, "revisit"), (2, "response"), (2, "response")]


def archive(parts):
    return pa.BufferReader(b"".join(parts))


def plain(kind, body, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", "Content-Type": "text/plain", "Content-Length": len(body)} | more
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("payload", [True, False])
def test_foreign_archives(pack, payload):
    """Plain records and members without a length, wanted and not, with bodies that look like headers."""
    parts = [pack(plain("warcinfo", b"software: x\r\n\r\n")), pack(plain("response", b"A" * 70_000)), pack(plain("request", b"GET /\r\n\r\n")), pack(plain("response", b"last"))]
    got = list(warc.records(archive(parts), lambda h: h["warc-type"] == "response", payload))
    assert [h["content-length"] for h, _ in got] == ["70000", "4"]
    if payload:
        assert [b for _, b in got] == [b"A" * 70_000, b"last"]


class Counted(io.BytesIO):
    """An archive that counts the bytes that are read of it."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_own_members_are_valid_gzip_and_skipped():
    draw = random.Random(0)
    records = [warc.encode_record(i, f"http://h/{i}", draw.randbytes(4_000_000), None if i % 2 else 9, "2020-01-01T00:00:00Z") for i in range(6)]
    assert all(gzip.decompress(r).startswith(b"WARC/1.1\r\n") for r in records)
    whole = len(b"".join(records))

    def taken(wanted, payload):
        file = Counted(b"".join(records))
        got = list(warc.records(file, lambda h: h["x-page-id"] in wanted, payload))
        assert [h["x-page-id"] for h, _ in got] == list(wanted)
        return file.taken

    # Blocks of a megabyte are read at the head of each record; payloads that nobody wants are jumped over.
    assert taken(("1", "4"), False) < whole * 0.6
    assert taken(("0", "2", "4"), True) < whole * 0.6
    assert taken(tuple("012345"), False) < whole * 0.6
    assert taken(tuple("012345"), True) >= whole * 0.99


@pytest.mark.parametrize("payload", [True, False])
def test_every_record_of_a_member(payload):
    """One member with many records, records that go on in the next member, and members of both kinds in one archive."""
    own = [warc.encode_record(i, f"http://h/{i}", b"own" * 1000, None, "2020-01-01T00:00:00Z") for i in range(2)]
    many = [plain("response", bytes([65 + i]) * (10 if i % 3 else 300_000)) for i in range(7)]
    raw = b"".join(many)
    cut = [gzip.compress(raw[i : i + 5000]) for i in range(0, len(raw), 5000)]
    for parts, n in (([gzip.compress(raw)], 7), (cut, 7), ([own[0], gzip.compress(raw), own[1]], 9), ([gzip.compress(b"".join(many[:3])), gzip.compress(b"".join(many[3:]))], 7), ([own[0], *map(gzip.compress, many)], 8), ([own[0], *cut, own[1]], 9)):
        got = list(warc.records(archive(parts), payload=payload))
        assert len(got) == n
        if payload:
            assert [b for h, b in got if h["content-type"] == "text/plain"] == [bytes([65 + i]) * (10 if i % 3 else 300_000) for i in range(7)]
    # A length in the extra field that isn't that of one record.
    fake = bytearray(warc.encode_record(1, "http://h", b"x", None, "d"))
    two = gzip.compress(b"".join(many[1:3]))
    member = b"\x1f\x8b\x08\x04" + bytes(fake[4:16]) + len(two).to_bytes(4, "little") + (7).to_bytes(4, "little") + two[10:]
    assert len(list(warc.records(archive([member]), payload=payload))) == 2


def test_damaged_payloads_are_noticed(spark, tmp_path):
    good, bad = (warc.encode_record(i, "http://h", b"<p>text</p>", None, "d", d) for i, d in ((1, None), (2, "A" * 32)))
    (tmp_path / "a.warc.gz").write_bytes(good + bad)
    rows = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz").collect()}
    assert rows[1].intact and not rows[2].intact
    assert rows[1].payload_digest == rows[2].payload_digest == warc.digest(b"<p>text</p>") and rows[2].headers["warc-payload-digest"] == "sha1:" + "A" * 32
    assert [r.intact for r in warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz", payload=False).collect()] == [None, None]


def test_pushdown(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(PAGES, SHAPE), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w", payload=False)
    assert "payload" not in back.columns
    found = back.filter((F.col("record_type") == "revisit") & (F.col("page_id") == 1))
    assert [(r.page_id, r.refers_to) for r in found.collect()] == [(1, 2)]
    reader = warc.WarcReader("x", True)
    from pyspark.sql.datasource import EqualTo, In, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (1, 2)), EqualTo(("headers", "x-page-id"), "1"), StringContains(("target_uri",), "x"), EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 2 and len(reader.tests) == 3


def test_long_http_headers_of_plain_archives_without_payloads():
    import pyarrow as pa

    from querysmith.llm import warc

    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: " + b"c" * 20000 + b"\r\n\r\n"
    block = http + b"payload!" * 3000
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
    found = list(warc.records(pa.BufferReader((head + block + b"\r\n\r\n") * 2), payload=False))
    assert [warc._row(*r, False)["payload_bytes"] for r in found] == [24000, 24000]
