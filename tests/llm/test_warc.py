"""Archives: records and their headers, skipping, filters, manifests, and pages there and back."""

import base64
import glob
import gzip
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetab.llm import warc


def record(payload, kind="response", **more):
    row = {"record_type": kind, "record_id": "<urn:row:1>", "target_uri": "http://a.example/\r\nx", "date": "2024-01-01T00:00:00Z",
           "refers_to": "<urn:row:0>", "http_type": None, "payload": payload, "payload_digest": "sha1:OLD", "payload_length": 7}
    return warc.record_bytes(row | more)


PAYLOADS = [b"", b"x" * 200_000, b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n" * 50, "ü日".encode(), bytes(range(256)) * 700]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("payloads", [True, False])
def test_records_there_and_back(packed, payloads):
    data = b""
    for n, p in enumerate(PAYLOADS):
        for r in (record(p, target_uri=f"http://a.example/{n}"), record(None, "revisit")):
            data += warc.gzip_member(r) if packed else r
    if packed:
        assert len(gzip.decompress(data)) == sum(len(record(p, target_uri="http://a.example/0")) + len(record(None, "revisit")) for p in PAYLOADS)
    every = list(warc.records(pa.BufferReader(data), packed, lambda head: True, payloads))
    assert [r["record_type"] for r in every] == ["response", "revisit"] * len(PAYLOADS)
    assert [r["payload_length"] for r in every[::2]] == [len(p) for p in PAYLOADS] and {r["payload_length"] for r in every[1::2]} == {7}
    assert [r["payload"] for r in every[::2]] == (PAYLOADS if payloads else [None] * len(PAYLOADS))
    assert every[0]["http_status"] == 200 and every[1]["refers_to"] == "<urn:row:0>"
    one = list(warc.records(pa.BufferReader(data), packed, lambda head: head["warc-target-uri"].endswith("/2"), payloads))
    assert len(one) == 1 and one[0]["target_uri"] == "http://a.example/2"


def test_members_of_other_writers_and_damage():
    plain = [record(p) for p in PAYLOADS]
    data = b"".join(gzip.compress(r) for r in plain)  # no length in the member
    assert [r["payload"] for r in warc.records(pa.BufferReader(data), True, lambda h: True)] == PAYLOADS
    assert list(warc.records(pa.BufferReader(data), True, lambda h: False)) == []
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(data[:-30]), True, lambda h: True))
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(b"no record\r\n\r\n"), False, lambda h: True))


ROWS = [
    (1, "http://a.example/1", "<p>one", "x"), (2, "http://a.example/2", "<p>one", "x"), (3, None, "", "x"), (4, "http://a.example/4", None, "x"),
    (5, "http://a.example/5", "<p>fünf 日", None), (None, "http://a.example/n", "<p>one", "x"), (None, None, "<p>alone", "x"),
    (7, "http://a.example/7", "big " * 40_000, "x"), (8, "http://b.example/8", "<p>fünf 日", "x"), (8, "http://b.example/8", "<p>fünf 日", "x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("least", [0, 1, 100_000])
def test_pages(pages, compression, least):
    data = {i: (h or "").encode() for i, h in enumerate(r[2] for r in ROWS)}
    want = []
    for i, (page, *_) in enumerate(ROWS):
        ids = [r[0] for k, r in enumerate(ROWS) if data[k] == data[i] and r[0] is not None]
        first = min(ids, default=None)
        again = len(data[i]) >= least and first is not None and first != page
        want.append((page, len(data[i]), base64.b32encode(hashlib.sha1(data[i]).digest()).decode(), "revisit" if again else "response", first if again else None))
    got = warc.archived_pages(pages, compression=compression, min_bytes=least)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_filters_are_pushed(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_pages(pages, path)
    df = warc.read_warc(spark, path, split_bytes=1)
    assert df.where("record_type = 'revisit'").count() == 5
    some = df.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a.") & (F.col("payload_length") > 10))
    assert {r.record_id for r in some.collect()} == {"<urn:row:5>", "<urn:row:7>"}
    assert df.where("target_uri IS NULL").count() == 2 and df.where("NOT (target_uri <=> 'http://a.example/1')").count() == len(ROWS) - 1
    assert df.where("target_uri <> 'http://a.example/1'").count() == len(ROWS) - 3
    assert df.where("record_type IN ('revisit', 'request')").count() == 5
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 3), EqualTo(("http_status",), 200)]))
    assert len(left) == 2 and len(reader.filters) == 1
    assert warc.read_warc(spark, path, payloads="false").where("payload IS NOT NULL").count() == 0
    # what no manifest lists isn't read; a file or a folder without manifests is
    extra = glob.glob(path + "/*.gz")[0]
    with open(extra, "rb") as f, open(path + "/stray.warc.gz", "wb") as g:
        g.write(f.read())
    assert df.count() == len(ROWS)
    warc.write_pages(pages.where("page_id = 1"), path)
    assert warc.read_warc(spark, path).count() == len(ROWS) + 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other/a.warc").write_bytes(record(b"a") + record(b"b"))
    assert warc.read_warc(spark, str(tmp_path / "other")).count() == warc.read_warc(spark, str(tmp_path / "other/a.warc")).count() == 2


@pytest.mark.parametrize("packed", [True, False])
def test_headers_of_any_length(packed):
    """A record of a URL of 2 MiB, between others."""
    long = "http://a.example/" + "x" * (2 << 20)
    some = [record(b"one"), record(b"two", target_uri=long), record(b"three")]
    data = b"".join(warc.gzip_member(r) if packed else r for r in some)
    for payloads in (True, False):
        rows = list(warc.records(pa.BufferReader(data), packed, lambda head: True, payloads))
        assert rows[1]["target_uri"] == long and [r["payload_length"] for r in rows] == [3, 3, 5]
    assert [r["payload"] for r in warc.records(pa.BufferReader(data), packed, lambda head: len(head["warc-target-uri"]) < 99, True)] == [b"one", b"three"]


def test_page_with_a_long_url(spark):
    rows = [(1, "http://a.example/" + "y" * (2 << 20), "<p>a"), (2, None, None), (3, "", "<p>a")]
    found = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.id, r.record_type, r.refers_to) for r in found) == [(1, "response", None), (2, "response", None), (3, "revisit", 1)]
