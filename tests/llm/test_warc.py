"""WARC archives: exact round trips, and faults that the reader must find."""

import hashlib
import io
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityhop.llm import warc

SCHEMA = "page_id long, url string, html string"
DATE = "2024-01-01T00:00:00Z"


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_ids_are_held_by_record_ids(page):
    assert warc.page_of(warc.record_id(page)) == page


def test_foreign_record_ids_hold_no_page():
    assert [warc.page_of(x) for x in (None, "", "<urn:uuid:12345678-1234-4234-9234-123456789abc>", "<http://a/b>")] == [None] * 4


def one(payload=b"<p>x</p>", revisit=False, url="http://a/b c\r\nX: y"):
    return warc.record(5, url, payload, hashlib.sha1(payload).hexdigest(), 9 if revisit else None, revisit, DATE)


def test_records_parse_to_what_was_written():
    got = warc.parse(one())
    assert (got["payload"], got["payload_bytes"], got["payload_digest"]) == (b"<p>x</p>", 8, hashlib.sha1(b"<p>x</p>").hexdigest())
    assert got["fields"]["warc-target-uri"] == "http://a/b%20c%0D%0AX:%20y" and "x" not in got["fields"]
    again = warc.parse(one(revisit=True))
    assert (again["payload"], again["payload_bytes"], again["payload_digest"]) == (None, 8, got["payload_digest"])
    assert warc.page_of(again["fields"]["warc-refers-to"]) == 9


def test_headers_of_others():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nset-cookie: b\r\nTransfer-Encoding: chunked\r\nContent-Length: 99\r\n\r\nbody"
    head = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:x>\r\nWARC-Date: d\r\nNote: two\r\n lines\r\nWARC-Payload-Digest: sha256:00\r\nContent-Type: application/http\r\n"
    got = warc.parse(head + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block))
    assert got["payload"] == b"body" and got["payload_bytes"] == 4 and got["fields"]["note"] == "two lines"


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r[1:],
        lambda r: r + b"\n",
        lambda r: r[:-4],
        lambda r: r.replace(b"<p>x", b"<p>y"),
        lambda r: r.replace(b"WARC-Date: ", b"WARC-Day: "),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
        lambda r: r.replace(b"Content-Length: ", b"Content-Length: -"),
        lambda r: r.replace(b"\r\n\r\n", b"\n\n"),
        lambda r: r + r,
    ],
)
def test_faults_of_records(change):
    with pytest.raises(warc.Malformed):
        warc.parse(change(one()))


def archive(contents, raw=b"", packed=True):
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT) if raw else None
    compressor = zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
    lead = warc.dictionary_frame(raw) if packed else struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw
    return (lead if raw else b"") + b"".join(compressor.compress(c) for c in contents)


def dictionary():
    return zstandard.train_dictionary(2048, [b"<html><p>some words of page %d, and more words</p></html>" % (i * i) for i in range(400)]).as_bytes()


@pytest.mark.parametrize("packed", [True, False])
def test_frames_with_dictionary(packed):
    contents = [b"", b"one", b"<html><p>some words of page " * 40_000, bytes(range(256)) * 3_000, b"last"]
    data = archive(contents, dictionary(), packed)
    skip = struct.pack("<II", 0x184D2A50, 100_000) + b"z" * 100_000
    for file in (data, data + skip, archive(contents)):
        assert [c for _, c, e in warc.read_frames(io.BytesIO(file))] == contents
    offsets = [o for o, _, _ in warc.read_frames(io.BytesIO(data))]
    assert all(struct.unpack("<I", data[o : o + 4])[0] == warc.FRAME for o in offsets)


def test_faults_of_frames():
    contents = [b"one" * 100, b"two" * 100]
    raw = dictionary()
    good = archive(contents, raw)
    second = list(warc.read_frames(io.BytesIO(good)))[1][0]
    assert list(warc.read_frames(io.BytesIO(b""))) == []
    for bad, whole in [(good[:-3], 1), (good + b"x", 2), (good + b"garbage of some length", 2), (good[: second + 9] + b"\xff\xff" + good[second + 11 :], 1)]:
        got = list(warc.read_frames(io.BytesIO(bad)))
        assert [c for _, c, _ in got] == contents[:whole] + [None] and got[-1][2]
    without = good[len(warc.dictionary_frame(raw)) :]
    assert "dictionary" in list(warc.read_frames(io.BytesIO(without)))[0][2]


BIG = "é" * 600
PAGES = [
    (1, "http://a/1", BIG), (2, None, BIG), (9, "http://a/9", BIG), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "x" * 1000), (6, "u", "x" * 1000),
    (7, "u", None), (8, "u", ""), (None, "u", BIG), (None, "u", "n" * 2000), (None, "v", "n" * 2000), (-4, "u", "<p>\x00\r\n\r\nWARC/1.1</p>" * 200_000), (9, "http://b/9", BIG),
]


def expected(rows):
    body = lambda t: (t or "").encode()
    out = []
    for page, _, html in rows:
        b = body(html)
        ids = [p for p, _, h in rows if body(h) == b and p is not None]
        top = max(ids) if ids else None
        revisit = len(b) >= 1000 and page != top
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip_of_a_table(spark):
    extra = {c: F.lit(1) for c in ("id", "same", "first", "n", "payload", "revisit", "weight")}
    df = spark.createDataFrame(PAGES, SCHEMA).withColumns(extra).repartition(3)
    assert got(warc.round_trip(df)) == expected(PAGES)


def test_round_trip_of_many_copies(spark):
    rows = [(i, "u", BIG if i % 3 else f"{i % 50} " * 600) for i in range(3000)]
    assert got(warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(7))) == expected(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_small_archives_and_folders(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{i} " + "some text of a page " * (i % 40) + "</html>") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    made = warc.write_archives(df, f"file:{tmp_path}/out", archive_bytes=50_000, dictionary=warc.train(df))
    assert made.count() > 4 and made.agg(F.sum("n_records")).first()[0] == 500
    first = next((tmp_path / "out").glob("*.warc.zst")).read_bytes()
    assert struct.unpack("<I", first[:4])[0] == warc.DICTIONARY_FRAME
    records = warc.read_archives(warc.archives_in(spark, str(tmp_path / "out")))
    assert records.where("error is not null").isEmpty() and warc.dangling(records).isEmpty()
    assert records.where("record_type = 'warcinfo'").count() == made.count()
    back = {r["page_id"]: (r["target_uri"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in records.where("page_id is not null").collect()}
    assert back == {i: (u, h) for i, u, h in rows}
    # without the responses its revisits hang
    twice = spark.createDataFrame([(1, "u", BIG), (2, "u", BIG)], SCHEMA)
    pair = warc.read_archives(warc.write_archives(twice, str(tmp_path / "pair")))
    assert warc.dangling(pair.where("record_type = 'revisit'")).count() == 1


def test_a_broken_archive_reports_where_it_breaks(spark, tmp_path):
    bad = one().replace(b"<p>x", b"<p>y")
    (tmp_path / "a.warc.zst").write_bytes(archive([one(), bad, one(b"z")], dictionary()) + b"end of it")
    rows = warc.read_archives(warc.archives_in(spark, str(tmp_path))).orderBy("offset").collect()
    assert [r["record_type"] for r in rows] == ["response", None, "response", None]
    assert "digest" in rows[1]["error"] and "not read" in rows[3]["error"] and bytes(rows[2]["payload"]) == b"z"
