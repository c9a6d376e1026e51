"""WARC archives by way of a converter of legacy ARC files: version-specific header lines and declared lengths in, WARC records with synthesised fields out.

ARC: a file begins with a version block, whose second line gives the version and whose third names the fields of the header lines that follow; a
record is a header line, a body of the declared length and a line feed. WARC: identifiers are name-based UUIDs of target, date, digest and key, so a
conversion that runs twice gives equal records; timestamps come from the 14-digit (or shorter) dates; types from scheme and declared content type;
digests are SHA-1 of payload and block.

Pages are written as ARC records (version 1 and 2 by turns) and converted. Of records with equal payloads of at least REVISIT_BYTES the one with the
largest page_id is a response, and the others are revisits that hold headers alone.

Defined cases: null html is an empty payload; null url becomes urn:page:ID; white space and control characters of a url are percent-encoded; a null
page_id never is referred to while another row with its payload has one; repeated rows each yield a record, and equal rows with the largest page_id
are all responses; an empty table yields no row; other columns are ignored.
Recovery: as with token shards, archives have fresh names and only those in the written manifest are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import byte_slices, cut, file_system, read_tasks, shared_dir

REVISIT_BYTES, ROLL_BYTES = 1000, 256 << 20
#: Names of the header lines' fields by version, and of WARC's revisit profile.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EXTRA = ("Page-Id", "Refers-To-Page-Id")
PAGE_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes
    version: int


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", repr=False)


def arc_header(version: int, date: str = "19960101000000") -> bytes:
    body = f"{version} 0 quarry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = ["filedesc://pages.arc", "0.0.0.0", date, "text/plain", *([] if version == 1 else ["200", "-", "-", "0", "pages.arc"]), str(len(body))]
    return " ".join(line).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, offset: int = 0) -> bytes:
    line = [url, "0.0.0.0", date, content_type, *([] if version == 1 else ["200", "-", "-", str(offset), "pages.arc"]), str(len(body))]
    return " ".join(line).encode() + b"\n" + body + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block among them. Raises ValueError where a header line or a declared length does not hold."""
    names: tuple[str, ...] = ()
    version = 0
    while line := stream.readline():
        if line.strip() == b"":
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no declared length in header line {line[:80]!r}")
        body = stream.read(size := int(parts[-1]))
        if len(body) != size:
            raise ValueError(f"{size} bytes were declared and {len(body)} are there")
        if not names:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            lines = body.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split(" ")[0]) if lines and lines[0][:1].isdigit() else 1
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else ARC_FIELDS.get(version, ARC_FIELDS[1])
            own = ARC_FIELDS[2] if len(parts) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
            yield ArcRecord(dict(zip(own, parts, strict=False)), body, version)
            continue
        if len(parts) < len(names):
            raise ValueError(f"header line of {len(parts)} fields instead of {len(names)}: {line[:80]!r}")
        spare = len(parts) - len(names)  # blanks in an URL are the only ones that can be told
        yield ArcRecord(dict(zip(names, [" ".join(parts[: spare + 1]), *parts[spare + 1 :]], strict=True)), body, version)


def warc_date(arc_date: str) -> str:
    """ISO 8601 of a date of 4 to 14 digits; what is missing is the earliest."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    if len(digits) < 4:
        return "1970-01-01T00:00:00Z"
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header block and payload of an HTTP message; all is payload where there is no header."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if found is None else (block[: found.end()], block[found.end() :])


def convert(arc: ArcRecord, key: str = "") -> WarcRecord:
    """The WARC record of an ARC record; key tells records with equal target, date and payload apart."""
    f = arc.fields
    url, date = f["URL"], warc_date(f["Archive-date"])
    http = url.partition(":")[0].lower() in ("http", "https") or arc.body.startswith(b"HTTP/")
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if http and arc.body.startswith(b"HTTP/") else "resource"
    head, payload = split_http(arc.body) if kind == "response" else (b"", arc.body)
    digest = sha1_label(payload)
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, key)))}>",
        "WARC-Date": date,
        "Content-Type": {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind, f.get("Content-type") or "application/octet-stream"),
    }
    if kind == "warcinfo":
        headers["WARC-Filename"] = url.removeprefix("filedesc://")
        block = f"software: quarry\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {arc.version}\r\n".encode()
    else:
        headers |= {"WARC-Target-URI": url, "WARC-Payload-Digest": digest}
        if f.get("IP-address", "0.0.0.0") != "0.0.0.0":
            headers["WARC-IP-Address"] = f["IP-address"]
        block = arc.body
    headers |= {"WARC-Block-Digest": sha1_label(block), "Content-Length": str(len(block))}
    return WarcRecord(headers, block, payload)


def revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """A revisit of a response: the HTTP header alone, with the payload's digest and what it refers to."""
    head, _ = split_http(record.block)
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": refers_to, "WARC-Block-Digest": sha1_label(head), "Content-Length": str(len(head))}
    return WarcRecord(headers, head, record.payload)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in record.headers.items())]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + record.block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """The records of an uncompressed WARC stream; checks the block digests."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if sha1_label(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {headers['WARC-Record-ID']} does not hold")
        yield WarcRecord(headers, block, split_http(block)[1])


def _target(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


class _Archive:
    """A compressed archive, a gzip member for each record."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = file_system(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file, self.size, self.records = fs.open_output_stream(path, compression=None), 0, 0

    def add(self, record: WarcRecord) -> None:
        data = gzip.compress(warc_bytes(record), compresslevel=3, mtime=0)
        self.file.write(data)
        self.size += len(data)
        self.records += record.headers["WARC-Type"] != "warcinfo"


def write_archives(pages: DataFrame, date: str = "19960101000000") -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the manifest: uri, n_records."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first_id")
    linked = rows.join(first, (F.octet_length("html") >= REVISIT_BYTES) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("first_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []

        def close() -> None:
            archive.file.close()
            done.append({"uri": archive.uri, "n_records": archive.records})

        for b in batches:
            for n in byte_slices(b, 2, most=50):
                part = n.to_pylist()
                for version in (1, 2):
                    mine = [r for r in part if (r["page_id"] or 0) % 2 == version - 1]
                    if not mine:
                        continue
                    arc = bytearray(arc_header(version, date))
                    for r in mine:
                        payload = r["html"].encode()
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                        arc += arc_record(version, _target(r["url"], r["page_id"]), date, "text/html", head + payload, len(arc))
                    found = read_arc(io.BytesIO(bytes(arc)))
                    info = next(found)
                    if archive is None:
                        archive = _Archive(folder)
                        archive.add(convert(info, archive.uri))
                    for r, a in zip(mine, found, strict=True):
                        record = convert(a, str(r["page_id"]))
                        if r["first_id"] is not None:
                            same = record.headers["WARC-Payload-Digest"]
                            # the response's own target is in another row; its identifier is a name of what both rows know
                            record = revisit(record, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{same} {r['first_id']}')}>")
                            record.headers["Refers-To-Page-Id"] = str(r["first_id"])
                        elif len(record.payload) >= REVISIT_BYTES:
                            record.headers["WARC-Record-ID"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.headers['WARC-Payload-Digest']} {r['page_id']}')}>"
                        if r["page_id"] is not None:
                            record.headers["Page-Id"] = str(r["page_id"])
                        archive.add(record)
                    if archive.size > ROLL_BYTES:
                        close()
                        archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("uri", pa.string()), ("n_records", pa.int64())]))

    return cut(linked.mapInArrow(write, "uri string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """From the archives a row per record: PAGE_ROWS. Payload length and digest are those of the full payload, also of revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                fs, path = file_system(uri)
                out: list[dict] = []
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for r in read_warc(stream):
                        h = r.headers
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head = split_http(r.block)[0]
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                        if h["WARC-Type"] == "response" and (size != len(r.payload) or sha1_label(r.payload) != h["WARC-Payload-Digest"]):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not hold")
                        ids = [int(h[k]) if k in h else None for k in EXTRA]
                        out.append({"page_id": ids[0], "payload_bytes": size, "payload_digest": base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), "record_type": h["WARC-Type"], "refers_to": ids[1]})
                        if len(out) == 5000:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    return manifest.select("uri").repartition(read_tasks(manifest), "uri").mapInArrow(read, PAGE_ROWS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))


#: DuckDB's sha1 takes the text's UTF-8 bytes.
ORACLE = """with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, strlen(h) as n, sha1(h) as s from p),
    m as (select *, max(page_id) over (partition by s, n >= 1000) as f from d)
    select page_id, n as payload_bytes, s as payload_digest, case when n >= 1000 and page_id <> f then 'revisit' else 'response' end as record_type, case when n >= 1000 and page_id <> f then f end as refers_to from m"""
