"""Legacy ARC archives to WARC.

An ARC file opens with a version block whose header line names the file, then the format version, whose second line tells
which fields each record's header line has; records follow one another by their declared lengths.  The converter reads
the fields by that line, takes the block by its length, and synthesises what WARC asks for: record ids, ISO dates, the
record type and payload digests.  A payload that an earlier page already has becomes a revisit that refers to it.

Headers are ASCII and payloads UTF-8, so Spark's text writer puts the records in files on any file system; they are read
back as a stream of lines and parsed by Content-Length, so that a task holds one record at a time, however large its files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.textual import encoded
from factline.session import steps_folder

#: Field names of a record's header line by ARC version (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Records in a WARC file, so that many tasks can read them back.
FILE_RECORDS = 1024
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
ROW = "page_id long, url string, date string, block string, payload_bytes long, payload_digest string, payload_sha1 string"
DATE = "20200101000000"


def arc_file(records: list[tuple[str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, block) records, for tests and as the source of the conversion."""
    about = f"{version} {int(version == 2)} factline\n{FIELDS[version]}\n\n".encode()
    dash = " 200 - - 0 " + name if version == 2 else ""
    kind = "text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    out = [f"filedesc://{name} 0.0.0.0 {DATE} {kind} {len(about)}\n".encode(), about]
    for url, block in records:
        out.append(f"{url} 0.0.0.0 {DATE} text/html{dash} {len(block)}\n".encode())
        out += (block, b"\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (header fields, block) of an ARC file after its version block; lengths decide where a record ends."""
    fields, at = FIELDS[1].split(), 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if not line:  # the line feed between records
            at = end + 1
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            about = data[end + 1 : end + 1 + length].decode("utf-8", "replace").split("\n")
            if len(about) < 2 or not about[0][:1].isdigit():
                raise ValueError("no version in the ARC version block")
            fields = about[1].split()
        elif len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no ARC {len(fields)}-field header: {line[:80]!r}")
        else:
            length = int(values[-1])
            if end + 1 + length > len(data):
                raise ValueError(f"record is shorter than its length {length}")
            yield dict(zip(fields, values, strict=True)), data[end + 1 : end + 1 + length]
        at = end + 1 + length


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str | None) -> str:
    """A URL for a header line: blanks and controls percent-encoded, nothing as about:blank."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"


def http_block(page_id: int | None, html: str | None) -> bytes:
    body = encoded(html)
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(body)}\r\n\r\n".encode() + body


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that only a few pages are held in several forms at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as ARC files, every other one of version 2, and these parsed into records with their digests."""
    for batch in sliced(batches):
        pages = batch.to_pylist()
        for version in FIELDS:
            own = [p for p in pages if (p["page_id"] or 0) % 2 == version - 1]
            archive = arc_file([(safe_url(p["url"]), http_block(p["page_id"], p["html"])) for p in own], version)
            rows = []
            for head, block in parse_arc(archive):
                http, _, payload = block.partition(b"\r\n\r\n")
                page = re.search(rb"\r\nX-Page-Id: (-?\d+)", http)
                d = head["Archive-date"]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                rows.append((int(page[1]) if page else None, head["URL"], date, block.decode("utf-8"), len(payload), digest_of(payload), hashlib.sha1(payload).hexdigest()))
            if rows:
                names = ["page_id", "url", "date", "block", "payload_bytes", "payload_digest", "payload_sha1"]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def warc_record(page_id: int | None, url: str, date: str, block: str, size: int, digest: str, first: int | None) -> str:
    """One record without its last line feed, which the text writer adds.

    A revisit keeps the HTTP header only; its payload's size and digest are those of the full payload.
    """
    revisit = first is not None
    body = block.partition("\r\n\r\n")[0] + "\r\n\r\n" if revisit else block
    data = body.encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(data)}", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join([*head, f"Content-Length: {len(data)}", "", ""]) + body + "\r\n\r"


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([warc_record(*r) for r in rows], pa.string())], ["value"])


def parse_warc(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (header, block) of WARC files given as lines without their line feeds; lengths decide where a block ends."""
    lines = iter(lines)
    for line in lines:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:80]!r}")
        head = {}
        for field in lines:
            if field == b"\r":
                break
            name, _, value = field.decode("utf-8").removesuffix("\r").partition(": ")
            head[name] = value
        length, parts, got = int(head["Content-Length"]), [], 0
        for part in lines:
            parts.append(part)
            got += len(part) + 1
            if got >= length + 4:
                break
        data = b"\n".join(parts) + b"\n"
        if len(data) != length + 4 or not data.endswith(b"\r\n\r\n"):
            raise ValueError(f"record {head.get('WARC-Record-ID')} does not end after {length} bytes")
        yield head, data[:length]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    rows: list[tuple] = []
    number = lambda x: None if x is None else int(x)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for head, block in parse_warc(line for batch in batches for line in batch.column(0).cast(pa.binary()).to_pylist()):
        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        whole = kind == "revisit" or (len(payload) == size and digest_of(payload) == digest)
        whole = whole and head["WARC-Block-Digest"] == "sha1:" + digest_of(block)
        rows.append((number(head.get("X-Page-Id")), head["WARC-Target-URI"], size, digest, kind, number(head.get("X-Refers-To-Page")), whole))
        if len(rows) == 4096:
            yield made()
            rows.clear()
    if rows:
        yield made()


def convert_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> str:
    """Write ``pages`` (page_id, url, html) as WARC files converted from ARC; returns their folder.

    Of records with equal payloads of ``least_bytes`` or more, that with the smallest page_id is the response and the
    others revisit it.  A null html is an empty payload, a null url about:blank.  Rows with equal page_id and payload are
    one record twice, of the same type; a null page_id is never smallest while another has the payload, and among null
    ids alone all are responses.  No pages make no files.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    body = F.coalesce("html", F.lit(""))
    first = (
        pages.where(F.octet_length(body) >= least_bytes).groupBy(F.sha1(body.cast("binary")).alias("k"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    )
    records = pages.mapInArrow(_converted, ROW).join(first, F.col("payload_sha1") == F.col("k"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    folder = folder or f"{steps_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    whole = records.select("page_id", "url", "date", "block", "payload_bytes", "payload_digest", refers.alias("first"))
    whole.mapInArrow(_written, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)
    return folder


def read_archives(spark, folder: str) -> DataFrame:
    """A row per WARC record in the folder; ``intact`` tells that lengths and digests agree."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(folder)
    return lines.mapInArrow(_read, READ)
