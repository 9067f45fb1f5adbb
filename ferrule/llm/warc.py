"""Legacy archives: ARC in, WARC out, and WARC back to rows.

An ARC file starts with a version block that names the version (1 or 2) and its header fields; each record is a header line of those fields,
the last of them the declared length, then so many bytes. The converter reads both versions by the fields that the block declares and makes of
each record the WARC record that says the same: an identifier derived from what identifies the record, the 14-digit date as an ISO time, the
type by what the content is, and digests of block and payload. The version block becomes a warcinfo record, to which the others refer. A record
whose payload is known elsewhere becomes a revisit: its HTTP header stays, its payload does not. An HTTP header ends at the first empty line,
whether lines end in CR LF or, as old servers had it, in LF.

A very long payload is held whole by the task that has its row, one at a time. A date that isn't one becomes the epoch.

Archives are written by tasks under names that depend on the partition alone: a task that runs again replaces its own file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import new_path, table, written

#: Header fields of the two versions, fixed by the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID("6f1c0c1e-38f5-5a53-9a3c-3d5f0f5f7a10")
SOURCE_DATE = "20240101000000"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes
    offset: int


def arc_line(version: int, fields: dict[str, str]) -> bytes:
    """Blanks inside a value would end it, so they are escaped; a missing value is '-'."""
    return " ".join(re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), fields.get(f) or "-") for f in ARC_FIELDS[version]).encode() + b"\n"


def write_arc(records: Iterable[tuple[dict[str, str], bytes]], name: str, version: int = 2, date: str = SOURCE_DATE) -> bytes:
    """An ARC file of (fields, content); lengths and offsets are filled in."""
    block = f"{version} 0 ferrule\n{' '.join(ARC_FIELDS[version])}\n".encode()
    about = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Archive-length": str(len(block))}
    out = io.BytesIO()
    out.write(arc_line(version, about) + block + b"\n")
    for fields, content in records:
        out.write(arc_line(version, fields | {"Archive-length": str(len(content)), "Offset": str(out.tell())}))
        out.write(content)
        out.write(b"\n")
    return out.getvalue()


def read_arc(source, about: bool = False) -> Iterator[ArcRecord]:
    """The records after the version block (about: and that block before them) of a stream (or bytes), one at a time. Raises ValueError on a header line or a length that doesn't hold."""
    stream = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else source
    version, names, at = 0, (), 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if line in (b"\n", b"\r\n"):
            continue
        if not line.endswith(b"\n"):
            raise ValueError(f"no header line at {start}")
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        first = not version
        if not first and len(parts) != len(names):
            raise ValueError(f"{len(parts)} header fields at {start}; version {version} has {len(names)}")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ValueError(f"no length at {start}") from None
        content = stream.read(max(length, 0))
        at += len(content)
        if length < 0 or len(content) < length:
            raise ValueError(f"the record at {start} is cut off")
        if first:
            lines = content.decode("utf-8", "replace").splitlines()
            if not parts[0].startswith("filedesc:") or len(lines) < 2 or not lines[0][:1].isdigit():
                raise ValueError("no version block")
            version, names = int(lines[0].split(" ")[0]), tuple(lines[1].split(" "))
            if version not in ARC_FIELDS or len(names) != len(ARC_FIELDS[version]):
                raise ValueError(f"unknown version {lines[0]!r}")
            if about:
                # Its own line has the fields of the first version, whatever it declares.
                yield ArcRecord(version, {"URL": parts[0], "Archive-date": parts[2] if len(parts) > 2 else ""}, content, start)
        else:
            yield ArcRecord(version, {k: "" if v == "-" else v for k, v in zip(names, parts)}, content, start)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """YYYYMMDD or YYYYMMDDhhmmss; what is missing is zero, and what is no date or time the epoch."""
    d = date.ljust(14, "0")
    try:
        if not re.fullmatch("[0-9]{14}", d):
            raise ValueError
        return datetime.strptime(d, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names for S3 are S3's here."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, key)}>"


#: The empty line after an HTTP header.
_HEADER_END = re.compile(rb"\r?\n\r?\n")


def warcinfo(rec: ArcRecord, name: str) -> tuple[dict[str, str], bytes]:
    """(headers, block) of what a version block says."""
    first = rec.content.decode("utf-8", "replace").splitlines()[0]
    block = f"software: ferrule\r\nformat: WARC File Format 1.1\r\nisPartOf: {rec.fields['URL']}\r\ndescription: converted from an archive of version {first}\r\n".encode()
    h = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"warcinfo {name}"), "WARC-Date": iso_date(rec.fields["Archive-date"]), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return h | {"WARC-Block-Digest": sha1_base32(block), "Content-Length": str(len(block))}, block


def to_warc(rec: ArcRecord, key: str | None = None, refers: str | None = None, more: dict[str, str] | None = None) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the same record in WARC. key identifies the record (else what it says does); refers: the key of the one it repeats."""
    f, block = rec.fields, rec.content
    http = block.startswith(b"HTTP/")
    end = _HEADER_END.search(block) if http else None
    cut = end.end() if end else len(block) if http else 0
    payload = block[cut:]
    digest = sha1_base32(payload)
    key = key or f"{f['URL']} {f['Archive-date']} {digest} {rec.offset}"
    h = {"WARC-Type": "response" if http else "resource", "WARC-Record-ID": record_id(key), "WARC-Date": iso_date(f["Archive-date"]), "WARC-Target-URI": f["URL"]}
    if f.get("IP-address") and f["IP-address"] != "0.0.0.0":
        h["WARC-IP-Address"] = f["IP-address"]
    h["Content-Type"] = "application/http; msgtype=response" if http else f.get("Content-type") or "application/octet-stream"
    h["WARC-Payload-Digest"] = digest
    if refers is not None:
        h |= {"WARC-Type": "revisit", "WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers)}
        block = block[:cut]
    h["WARC-Block-Digest"] = sha1_base32(block)
    return h | (more or {}) | {"Content-Length": str(len(block))}, block


def warc_bytes(headers: dict[str, str], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an uncompressed stream. Raises ValueError where it is malformed."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip()] = v.strip()
        block = stream.read(n := int(headers["Content-Length"]))
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield headers, block


def _http(page_html: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(page_html) + page_html


def member(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(warc_bytes(headers, block)) + z.flush()


def convert_archives(archives: DataFrame, root: str) -> DataFrame:
    """archives: path of ARC files, gzipped (.gz) or not. Writes one WARC file for each under root; returns source, path, records, problem.

    A file is read as a stream, so a task holds one record. A damaged file gives the records before the damage and says what it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = store_of(root)
        target.create_dir(base, recursive=True)
        task = TaskContext.get()
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = store_of(path)
                name = f"{hashlib.sha1(path.encode()).hexdigest()[:16]}-{re.sub(r'(.arc)?(.gz)?$', '', path.rsplit('/', 1)[-1])}.warc.gz"
                n, problem = 0, None
                temporary = f"{base}/_temporary-{task.taskAttemptId() if task else 0}-{name}"
                with store.open_input_stream(at, compression=None) as raw, target.open_output_stream(temporary, compression=None) as out:
                    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    try:
                        info = None
                        for rec in read_arc(stream, about=True):
                            if info is None:
                                info = warcinfo(rec, name)
                                out.write(member(*info))
                                continue
                            out.write(member(*to_warc(rec, f"{path} {rec.offset}", more={"WARC-Warcinfo-ID": info[0]["WARC-Record-ID"]})))
                            n += 1
                    except (ValueError, EOFError, zlib.error, gzip.BadGzipFile) as e:
                        problem = str(e)
                target.move(temporary, f"{base}/{name}")
                yield pa.RecordBatch.from_pydict({"source": [path], "path": [f"{root}/{name}"], "records": [n], "problem": pa.array([problem], pa.string())})

    return written(archives.select("path").mapInArrow(run, "source string, path string, records long, problem string"), "converted")


#: ARC bytes that a task holds at once, besides one page.
SEGMENT = 4 << 20


def _write_task(root: str, version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        store, base = store_of(root)
        store.create_dir(base, recursive=True)
        temporary, final = f"{base}/_temporary-{part}-{attempt}", f"{base}/part-{part:06d}.warc.gz"
        done = size = 0
        out = None
        held: list[tuple[dict[str, str], bytes]] = []
        links: list[tuple[str, str | None]] = []

        def convert():
            nonlocal done, size
            arc = write_arc(held, f"part-{part:06d}-{done}.arc", version)
            records = read_arc(arc, about=True)
            info = warcinfo(next(records), f"part-{part:06d}-{done}")
            out.write(member(*info))
            for rec, (page, top) in zip(records, links):
                more = {"WARC-Warcinfo-ID": info[0]["WARC-Record-ID"], "Ferrule-Page": page} | ({"Ferrule-Refers-To-Page": top} if top is not None else {})
                data = member(*to_warc(rec, f"page {page}", None if top is None else f"page {top}", more))
                out.write(data)
                size += len(data)
                done += 1
            held.clear()
            links.clear()

        waiting = 0
        for b in batches:
            if out is None and b.num_rows:
                out = store.open_output_stream(temporary, compression=None)
            for page, url, html, top in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                html = html.as_py() or b""
                held.append(({"URL": url, "IP-address": "127.0.0.1", "Archive-date": SOURCE_DATE, "Content-type": "text/html", "Result-code": "200"}, _http(html)))
                links.append(("" if page is None else str(page), None if top is None else str(top)))
                waiting += len(html) + 300
                if waiting >= SEGMENT:
                    convert()
                    waiting = 0
        if out is not None:
            convert()
            out.close()
            store.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/part-{part:06d}.warc.gz"], "records": [done], "bytes": [size]})

    return run


def write_archives(pages: DataFrame, root: str, version: int = 2) -> DataFrame:
    """pages: page_id, url, html (binary), refers_to. Writes gzipped WARC under root, a file per task; returns path, records, bytes."""
    manifest = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"), F.col("refers_to").cast("long"))
    return written(manifest.mapInArrow(_write_task(root, version), "path string, records long, bytes long"), "manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string"


def read_archives(paths: DataFrame) -> DataFrame:
    """paths: path. A row per record, as READ; digests of responses are checked against their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in READ.split(", ")])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                store, at = store_of(path)
                with store.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in read_warc(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        declared = h["WARC-Payload-Digest"]
                        n = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1])
                        if h["WARC-Type"] == "response" and (sha1_base32(payload) != declared or len(payload) != n):
                            raise ValueError(f"{path}: the payload of {h['WARC-Record-ID']} isn't what its header says")
                        number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                        rows.append((number("Ferrule-Page"), h["WARC-Target-URI"] or None, n, base64.b32decode(declared[5:]).hex(), h["WARC-Type"], number("Ferrule-Refers-To-Page"), h["WARC-Record-ID"], h["WARC-Date"]))
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return paths.select("path").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, least: int = 1000, version: int = 2, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes a record per page and returns (manifest, records read back).

    Of pages with equal payloads of at least `least` bytes, that with the largest page_id is the response and others revisit it. A null html is
    an empty payload; a null page_id ranks below all and is written without a number; rows with the same largest page_id are all responses.
    An empty table gives empty results. Only page_id, url and html are read.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("digest", F.sha1("html"))
    large = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(groups, "digest").where("page_id is null or page_id < refers_to").where("refers_to is not null").distinct()
    again = written(again, "revisits").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    decided = pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to")
    manifest = write_archives(decided, root or new_path(spark, "warc"), version)
    n = max(1, manifest.count())
    return manifest, read_archives(manifest.select("path").repartition(n))


def op2_legacy_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))[1].select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""
