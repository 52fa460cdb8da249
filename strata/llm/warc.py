"""Operator 9: legacy ARC archives to WARC, with digests and revisits, written and read back.

An ARC file starts with a version block whose first line names version 1 or 2; every record
is a header line (URL, IP address, archive date, content type, [v2: result code, checksum,
location, offset, file name,] length) and as many bytes as the line declares. The converter
reads header lines and lengths, never delimiters, and synthesises WARC headers: the type,
a record identifier derived from the record's URI, date and digest (so that a task that runs
again writes the same), the timestamp from the 14-digit date, and SHA-256 digests.

Records of one payload digest and at least ``least`` bytes are written once: the one with
the smallest key is a response, the others become revisits that name it. The first one per
digest is a partial minimum before the shuffle and comes back by a shuffle join that
adaptive execution splits, so a payload that most pages share gathers in no task. Archives
are written and read by Spark's own sources (text with the record as row, and binaryFile),
so they lie wherever the shared folder does; a file holds at most ``per_file`` records.

Cases: a NULL payload is empty (0 bytes, a response); a NULL URL is written as
"urn:none"; a NULL page_id is kept as "-" in the archive and comes back as NULL, and is the
response of its payload only if no page of that payload has an id; rows that share a page_id
all count, and the rows with the smallest id are responses; an empty table writes no
records; extra columns are ignored. A malformed ARC header line or a record cut short raises.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.session import scratch_path

# Fixed by the ARC file format: the field lists of its two versions, and the date's form.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length".split(),
          2: ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
              "Filename Archive-length").split()}
# Fixed by the WARC file format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
KEY = "#page-key="                                # behind it, in the URLs of our own archives, the page's key


def parse_arc(data: bytes):
    """(url, ip, 14-digit date, content type, payload) of every record of an ARC file."""
    view, at, version = memoryview(data), 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without an end")
        line = data[at:end].decode("utf-8").rstrip("\r")
        at = end + 1
        if not line:
            continue                              # the blank line after a record
        parts = line.split(" ")
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file must start with a version block")
            body = bytes(view[at:at + int(parts[-1])])
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            at += len(body)
            continue
        names = FIELDS[version]
        # a content type may hold spaces ("text/html; charset=utf-8"): take the fields from both ends
        tail = len(names) - 4
        if len(parts) < len(names):
            raise ValueError(f"ARC header line has {len(parts)} fields, not {len(names)}: {line[:200]}")
        size = int(parts[-1])
        if at + size > len(data) or size < 0:
            raise ValueError("ARC record is shorter than its declared length")
        yield parts[0], parts[1], parts[2], " ".join(parts[3:len(parts) - tail]), view[at:at + size]
        at += size


def write_arc(records, version: int) -> bytes:
    """An ARC file of (url, ip, date, content type, payload) records."""
    note = f"{version} 0 strata\n{' '.join(FIELDS[version])}\n".encode()
    out = [f"filedesc://strata.arc 0.0.0.0 {DATE} text/plain "
           f"{'200 - - 0 strata.arc ' if version == 2 else ''}{len(note)}\n".encode(), note, b"\n"]
    for url, ip, date, kind, payload in records:
        extra = "200 - - 0 strata.arc " if version == 2 else ""
        out += [f"{url} {ip} {date} {kind} {extra}{len(payload)}\n".encode(), payload, b"\n"]
    return b"".join(out)


def pages_as_arc(pages: DataFrame, key_col: str, url_col: str, body_col: str, per_file: int) -> DataFrame:
    """Stand-in input: ARC files (one binary per row) of page rows, in both versions. The
    page's key goes behind the URL, as an archive has no other place for it; white space in a
    URL becomes "_", since blanks part the fields of a header line."""
    def run(batches):
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, per_file):
                part = batch.slice(at, per_file)
                rows = []
                for key, url, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    body = body.as_buffer().to_pybytes() if body.is_valid else b""
                    url = re.sub(r"\s", "_", url) if url else "urn:none"
                    rows.append((f"{url}{KEY}{'-' if key is None else key}", "0.0.0.0", DATE, "text/html", body))
                turn += 1
                yield pa.RecordBatch.from_pydict({"arc": pa.array([write_arc(rows, 1 + turn % 2)], pa.binary())})
    return pages.select(F.col(key_col).cast("long").alias("k"), F.col(url_col).alias("u"),
                        F.col(body_col).alias("b")).mapInArrow(run, "arc binary")


def arc_records(archives: DataFrame, column: str = "arc") -> DataFrame:
    """Rows of ARC files to rows of records: uri, key, ip, date, mime, payload, size, digest."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out, held = [], 0
                for url, ip, date, mime, payload in parse_arc(data.as_buffer().to_pybytes()):
                    uri, _, key = url.rpartition(KEY) if KEY in url else (url, "", "")
                    body = bytes(payload)
                    out.append((uri, int(key) if re.fullmatch(r"-?[0-9]+", key) else None, ip, date, mime, body, len(body),
                                hashlib.sha256(body).hexdigest()))
                    held += len(body)
                    if held > 4 << 20:
                        yield table(out)
                        out, held = [], 0
                yield table(out)

    def table(out):
        columns = list(zip(*out)) or [[]] * 8
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          names=["uri", "key", "ip", "date", "mime", "payload", "size", "digest"])
    return archives.select(column).mapInArrow(
        run, "uri string, key long, ip string, date string, mime string, payload binary, size long, digest string")


def _warc_text(batches):
    """Records (with is_first and refers) to WARC records as text, without the two line ends
    that close a record: the text writer sets those."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            day = r["date"]
            stamp = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z"
            name = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['key']} {r['uri']} {day} {r['digest']}")
            body = b"" if r["refers"] is not None else r["payload"]
            head = [VERSION, f"WARC-Type: {'response' if r['refers'] is None else 'revisit'}",
                    f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {stamp}",
                    f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}",
                    f"WARC-Payload-Digest: sha256:{r['digest']}",
                    f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
                    f"X-Page-Key: {'-' if r['key'] is None else r['key']}",
                    f"X-Payload-Length: {r['size']}"]
            if r["refers"] is not None:
                head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {r['refers']}"]
            head += [f"Content-Type: {r['mime']}", f"Content-Length: {len(body)}", "", ""]
            out.append("\r\n".join(head) + body.decode("utf-8"))
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def with_revisits(records: DataFrame, least: int = 100) -> DataFrame:
    """Adds ``refers``: the smallest key of an equal payload of at least ``least`` bytes, for
    all records but those that have that key themselves."""
    first = (records.filter(f"size >= {int(least)}").groupBy("digest", "size")
             .agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    # Equal digests meet in a shuffle join; a payload that most rows share is split.
    return (records.join(first, ["digest", "size"], "left")
            .withColumn("refers", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))).drop("first"))


def write_warc(records: DataFrame, path: str, least: int = 100, per_file: int = 1000) -> None:
    """Writes records as gzip-compressed WARC files under ``path``."""
    (with_revisits(records, least).mapInArrow(_warc_text, "value string")
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse_warc(data: bytes):
    """(headers, block) of every record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        body = data[end + 4:end + 4 + size]
        at = end + 4 + size
        if len(body) < size or data[at:at + 4] != b"\r\n\r\n":
            raise ValueError("WARC record is shorter than its declared length")
        at += 4
        yield head, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the records under ``path``: key, uri, record_type, record_id, date, mime,
    payload_bytes, payload_digest, refers_to, and the payload (NULL for a revisit). Digests
    of blocks, and of a response's payload, are computed again and must agree."""
    def run(batches):
        import zlib
        for batch in batches:
            for data in batch.column(0):
                out, held = [], 0
                for head, body in parse_warc(zlib.decompress(data.as_buffer(), 47)):
                    seen = hashlib.sha256(body).hexdigest()
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if seen != head["WARC-Block-Digest"].removeprefix("sha256:") or (
                            kind == "response" and seen != digest):
                        raise ValueError("a WARC record's digest does not fit its block")
                    key, refers = head["X-Page-Key"], head.get("X-Refers-To-Key")
                    out.append((None if key == "-" else int(key), head["WARC-Target-URI"], kind,
                                head["WARC-Record-ID"], head["WARC-Date"], head["Content-Type"],
                                int(head["X-Payload-Length"]), digest, None if refers is None else int(refers),
                                body if kind == "response" else None))
                    held += len(body)
                    if held > 4 << 20:
                        yield table(out)
                        out, held = [], 0
                yield table(out)

    def table(out):
        columns = list(zip(*out)) or [[]] * 10
        types = ([pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = "key uri record_type record_id date mime payload_bytes payload_digest refers_to payload".split()
    schema = ("key long, uri string, record_type string, record_id string, date string, mime string, "
              "payload_bytes long, payload_digest string, refers_to long, payload binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def pages_to_warc(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  least: int = 100, per_file: int = 1000, path: str | None = None) -> DataFrame:
    """Archives pages (as ARC, converted to WARC under ``path``) and reads the WARC files back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(arc_records(pages_as_arc(pages, key_col, url_col, body_col, per_file)), path, least, per_file)
    return read_warc(pages.sparkSession, path)
