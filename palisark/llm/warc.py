"""WARC archives: a writer that Spark's own sink carries, and a reader that salvages damaged files.

Writer. Each record is one gzip member. Members go out through the text sink, so the commit protocol, any Hadoop file
system and a lost executor are Spark's business: a binary value cast to string is written as it is, and the line
separator is the members' common last byte (the high byte of a length below 16 MiB is 0; a longer record gets an empty
member behind it).

Reader. A record is accepted if its member inflates with the right checksum, its header parses, its length agrees and
its block digest holds. After a failed check the reader goes on one byte further to the next gzip magic or WARC version
line from which a whole valid record can be read, and logs what lies between as a quarantined gap. It does so too inside
the content of a member of several records, also of one that inflates in part or with a wrong checksum: there a record
needs a block digest that holds. Nothing is lost but the damaged record itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisark.session import shared_path, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Records whose payload has at least so many bytes may be revisits.
MIN_REVISIT_BYTES = 0
MAX_RECORDS_PER_FILE = 4096
#: Payload bytes of a file at most (one record may be larger): a file is read back by one task.
MAX_FILE_BYTES = 256 << 20
#: A map of repeated payloads of up to this many rows (40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
_LAST_BYTE = b"\x00"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value: controls and white space become percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to`` with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    lines = [
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url) if url else 'urn:unknown'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, compressed: bool = True, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record for each row (page_id, url, html) into archives in folder ``path``.

    Of rows with equal payloads the one with the largest page_id is the response, the others revisit it; rows that
    repeat it with the same page_id are responses too. A null html is an empty payload; a null page_id is smaller than
    any. No file has more than MAX_RECORDS_PER_FILE records or, by the largest payload, MAX_FILE_BYTES of payload, but for a
    single record that is larger. Payloads are compared by SHA-1 and length. Texts are only shuffled if the map of repeated payloads is too large
    to broadcast; its join is then on the payload's digest, and a hot one is split by adaptive execution.
    """
    html = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    repeated = written(
        rows.where(F.col("n_bytes") >= min_revisit_bytes)
        .groupBy("sha1", "n_bytes")
        .agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "revisits",
    )
    records = max(1, min(MAX_RECORDS_PER_FILE, MAX_FILE_BYTES // max(1, rows.agg(F.max("n_bytes")).first()[0] or 0)))
    small = repeated.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if small else repeated, ["sha1", "n_bytes"], "left").select(
        "page_id", "url", F.when(F.col("keep").isNull() | F.col("page_id").eqNullSafe(F.col("keep")), F.col("payload")).alias("payload"), "n_bytes", "sha1", "keep"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = _member(b"")
        for x in batches:
            for i in range(0, len(x), 256):
                out = []
                for r in x.slice(i, 256).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    data = record(r["page_id"], r["url"], r["payload"], r["n_bytes"], digest, r["keep"])
                    if compressed:
                        data = _member(data)
                        if data[-1:] != _LAST_BYTE:
                            data += end
                        data = data[:-1]
                    else:
                        data = data[:-4]
                    out.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["data"])

    lines = rows.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    separator = _LAST_BYTE.decode() if compressed else "\r\n\r\n"
    lines.write.option("lineSep", separator).option("maxRecordsPerFile", records).option("compression", "none").text(path)


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
#: The fields that every record must have.
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")


def _parse(data: bytes, start: int = 0, digest: bool = False) -> tuple[dict, bytes, int] | None:
    """The record at ``start``: fields, block and size; None unless every check holds, of the block digest too if asked."""
    m = _VERSION.match(data, start)
    if not m:
        return None
    at, fields = m.end(), {}
    while data[at : at + 2] != b"\r\n":
        m = _FIELD.match(data, at)
        if not m:
            return None
        fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    if any(name not in fields for name in MANDATORY):
        return None
    size = fields["content-length"]
    if not re.fullmatch("[0-9]{1,18}", size):
        return None
    stop = at + 2 + int(size)
    if len(data) < stop + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[at + 2 : stop]
    told = fields.get("warc-block-digest", "")
    if (digest or told.startswith("sha1:")) and told != "sha1:" + base32_sha1(block):
        return None
    return fields, block, stop + 4 - start


def _inflate(view: memoryview, at: int) -> tuple[bytes, int, bool]:
    """Content and size of the gzip member at ``at``, and if it is whole and its checksum right; else what inflates of it.

    Input is fed in growing windows: zlib copies what it doesn't use, and most members are small. Where one fails, it is
    fed again in ever smaller ones up to the byte that can't be right.
    """
    z, out, fed, window = zlib.decompressobj(31), [], at, 1 << 15
    while not z.eof and fed < len(view):
        before = z.copy()
        try:
            out.append(z.decompress(view[fed : fed + window]))
        except zlib.error:
            if window == 1:
                return b"".join(out), fed - at, False
            z, window = before, max(1, window // 8)
            continue
        fed = min(fed + window, len(view))
        window *= 2
    return b"".join(out), fed - len(z.unused_data) - at, z.eof


def _records(content: bytes, whole: bool) -> tuple[list[tuple[dict, bytes, bytes]], bool]:
    """Fields, block and bytes of the valid records in a member's content, and if they are all that is in it.

    A member of one record stands and falls with it: if its checksum is wrong, so is the record.
    """
    found, at, good = [], 0, True
    while at < len(content):
        if r := _parse(content, at, not whole):
            found.append((r[0], r[1], content[at : at + r[2]]))
            at += r[2]
            continue
        good = False
        m = _VERSION.search(content, at + 1)
        at = m.start() if m else len(content)
    if not whole and good and len(found) == 1:
        return [], False
    return found, good and whole


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes]]:
    """(offset, length, fields, block) of each record of an archive; fields is None for a quarantined gap.

    Offsets and lengths are those in the file. Gaps and records together cover it without overlap, but for a member of
    several records: they have its range, and so has the gap that stands for what is damaged inside it. The range of a
    member whose end is damaged runs on to the next valid record.
    """
    view, n = memoryview(data), len(data)
    at = good = 0
    parts: list[tuple[int, list]] = []  # members since ``good`` that were salvaged in part
    seen, until = set(), 0  # what was found in them, and where the last ends

    def close(stop: int) -> Iterator[tuple[int, int, dict | None, bytes]]:
        first = parts[0][0] if parts else stop
        if good < first:
            yield good, first - good, None, b""
        for (start, inside), (end, _) in zip(parts, [*parts[1:], (stop, [])]):
            yield from ((start, end - start, fields, block) for fields, block, _ in inside)
            yield start, end - start, None, b""
        parts.clear()
        seen.clear()

    while at < n:
        found = None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            content, size, whole = _inflate(view, at)
            if whole and not content:
                found = []
            elif content:
                inside, clean = _records(content, whole)
                inside = [r for r in inside if not (at < until and r[2] in seen)]
                if clean and inside:
                    found = [(at, size, fields, block) for fields, block, _ in inside]
                elif inside:
                    parts.append((at, inside))
                    seen.update(r[2] for r in inside)
                    if whole:
                        yield from close(at + size)
                        at = good = at + size
                        continue
                    until = at + size
        elif (r := _parse(data, at)) and not (at < until and data[at : at + r[2]] in seen):  # as stored in a damaged member
            found, size = [(at, r[2], r[0], r[1])], r[2]
        if found is None:
            m = _START.search(data, at + 1)
            at = m.start() if m else n
            continue
        yield from close(at)
        yield from found
        at = good = at + size
    yield from close(n)


RECORD_SCHEMA = (
    "file string, offset long, length long, gap boolean, record_type string, page_id long, url string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)


def _number(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return int(m[1]) if m else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives in folder ``path``, compressed or not, damaged or not (see RECORD_SCHEMA).

    For a gap only file, offset and length are set. A payload whose digest isn't the one told makes its record a gap
    too. payload_bytes of a revisit is the length that its HTTP headers tell. An empty folder gives an empty result. A
    file is read by one task: archives are files of bounded size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.bool_()), ("record_type", pa.string()),
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for x in batches:
            for name, content in zip(x.column(0), x.column(1)):
                out, size = [], 0
                for offset, length, fields, block in salvage(content.as_py()):
                    row = _row(name.as_py(), offset, length, fields, block)
                    size += len(row["payload"] or b"")
                    if not payloads:
                        row["payload"] = None
                    out.append(row)
                    if len(out) >= 1024 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return files.mapInArrow(run, RECORD_SCHEMA)


def _row(name: str, offset: int, length: int, fields: dict | None, block: bytes) -> dict:
    row = dict.fromkeys(("record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload"))
    row |= {"file": name, "offset": offset, "length": length, "gap": True}
    if fields is None:
        return row
    head, cut, payload = block.partition(b"\r\n\r\n")
    if fields.get("content-type", "").startswith("application/http") and not cut:
        return row
    if not fields.get("content-type", "").startswith("application/http"):
        head, payload = b"", block
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    if kind == "revisit":
        m = re.search(rb"(?i)^content-length:[ \t]*([0-9]+)", head, re.M)
        size, payload = int(m[1]) if m else None, None
    else:
        if told and told != base32_sha1(payload):
            return row
        size, told = len(payload), told or base32_sha1(payload)
    return row | {
        "gap": False, "record_type": kind, "page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
        "payload_digest": told or None, "payload_bytes": size, "refers_to": _number(fields.get("warc-refers-to")), "payload": payload,
    }


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined byte ranges: file, offset, length."""
    return records.where("gap").select("file", "offset", "length")


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes all pages into archives in the shared folder, reads these back: a row per page, from the archive alone."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, min_revisit_bytes=min_revisit_bytes)
    found = read(pages.sparkSession, path, payloads=False)
    return found.where("not gap").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
