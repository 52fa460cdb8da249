"""Operator 9: ARC parsing, WARC writing and reading."""
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from strata.llm import warc
from strata.session import scratch_path


def arc_of(version):
    rows = [("http://a/x?y=1#3", "1.2.3.4", "20010203040506", "text/html; charset=utf-8", b"body\nfiledesc://x\n"),
            ("http://b/", "0.0.0.0", "19990101000000", "text/plain", b"")]
    return rows, warc.write_arc(rows, version)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rows, data = arc_of(version)
    assert [(*r[:4], bytes(r[4])) for r in warc.parse_arc(data)] == rows
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-4].replace(b"plain 0", b"plain 99").replace(b"arc 0", b"arc 99")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 0.0.0.0 20010203040506 text/html 0\n"))


def test_pages_round_trip(spark):
    big = "<p>é</p>" * 50
    rows = [(5, "http://a/ b#c", big), (3, "http://b", big), (9, "http://b", big), (4, "http://c", "small"),
            (6, "http://d", "small"), (7, None, None), (8, "u", "WARC/1.1\r\n\r\n" + "x\r\n\r\n" * 30), (None, "n", big),
            (10, "long", "z" * 3_000_000), (3, "http://again", big), (11, "e", "a" * 99), (12, "e", "a" * 99),
            (13, "e", "a" * 100), (14, "e", "a" * 100)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc-test")
    out = warc.pages_to_warc(df.repartition(3), per_file=2, path=path).collect()
    assert len(out) == len(rows)
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        refers = first.get(b) if first.get(b) != i else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(bytes(r.payload) == dict((x[0], (x[2] or "").encode()) for x in rows)[r.key]
               for r in out if r.record_type == "response" and r.key is not None)
    one = spark.read.format("binaryFile").load(path + "/*.gz").orderBy(F.desc("length")).first()
    assert gzip.decompress(one.content).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.pages_to_warc(df).count() == 0


def test_urls_keep_their_fragments(spark):
    rows, _ = arc_of(1)
    real = warc.write_arc([("http://a/page#section", "1.2.3.4", "20010203040506", "text/html", b"body"), *rows], 1)
    frame = spark.createDataFrame([(bytearray(real),)], "arc binary")
    assert [(r.uri, r.key) for r in warc.arc_records(frame).collect()] == [
        ("http://a/page#section", None), ("http://a/x?y=1#3", None), ("http://b/", None)]
    pages = spark.createDataFrame([(-4, "http://a/#top", "x"), (5, "http://b/ c#d", "y")], "page_id long, url string, html string")
    assert sorted((r.key, r.uri) for r in warc.pages_to_warc(pages).collect()) == [(-4, "http://a/#top"), (5, "http://b/_c#d")]
