"""Legacy web archives (ARC) turned into WARC records, written and read back.

An ARC file opens with a version block whose second line names the version;
from it on, a record is one header line (five fields in version 1, ten in
version 2), the declared number of bytes, and a line break.  Only declared
lengths decide where a record ends.  WARC asks for more than ARC states, so
record ids, ISO timestamps, record types and digests are derived: the same ARC
record always gives the same WARC record.

Among records with equal payloads of at least ``least_bytes`` bytes the one
with the largest key stays a response, others become revisits that refer to
it.  Null payloads count as empty; a null key sorts below every other; rows
that repeat a key and its payload stay responses together.  A null URL is
written as ``-``.  Very long payloads are kept whole, in a file of their own; ties
in the largest key are settled by record id; an empty table gives empty archives and
no records.  Columns of the input other than key, URL and payload are not read.
Malformed ARC data raises ValueError with the file and place.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header fields by version, as the format's definition orders them.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
FIELD_LINE = {
    1: b"URL IP-address Archive-date Content-type Archive-length\n",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
EPOCH = dt.datetime(2000, 1, 1)
KEY_HEADER = "X-Page-Id"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORDS = (
    "file string, place long, warc_type string, uri string, ip string, date string, record_id string, "
    "payload_digest string, payload_bytes long, page_key long, head binary, payload binary"
)
READ = (
    "warc_type string, uri string, date string, record_id string, refers_to_id string, "
    "payload_digest string, payload_bytes long, page_key long, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


# -- ARC ----------------------------------------------------------------------


def _arc_record(version: int, url: str, moment: dt.datetime, body: bytes, name: str, at: int) -> bytes:
    stamp = moment.strftime("%Y%m%d%H%M%S")
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    rest = [] if version == 1 else ["200", "-", "-", str(at), name]
    line = " ".join([url, "0.0.0.0", stamp, "text/html", *rest, str(len(body))])
    return line.encode() + b"\n" + body + b"\n"


def arc_file(version: int, name: str, bodies: list[tuple[str, dt.datetime, bytes]]) -> bytes:
    """One ARC file of (url, moment, content) records."""
    block = f"{version} 0 wardlight\n".encode() + FIELD_LINE[version] + b"\n"
    stamp = EPOCH.strftime("%Y%m%d%H%M%S")
    rest = [] if version == 1 else ["200", "-", "-", "0", name]
    line = " ".join([f"filedesc://{name}", "0.0.0.0", stamp, "text/plain", *rest, str(len(block))])
    parts = [line.encode() + b"\n" + block + b"\n"]
    size = len(parts[0])
    for url, moment, body in bodies:
        parts.append(_arc_record(version, url, moment, body, name, size))
        size += len(parts[-1])
    return b"".join(parts)


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", file_bytes: int = 1 << 20) -> DataFrame:
    """Web pages as ARC files of about ``file_bytes``: (path, content).

    Versions 1 and 2 alternate.  Each page becomes an HTTP response whose
    headers carry its key and its payload's length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0

        def closed():
            version = 1 + count % 2
            name = hashlib.sha1(repr([k for k, _, _, _ in held]).encode()).hexdigest()[:16] + f"-{count}.arc"
            bodies = [(u, moment, content) for _, u, moment, content in held]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(version, name, bodies)], pa.binary())], ["path", "content"])

        for batch in batches:
            for page, address, html in zip(*(batch.column(c).to_pylist() for c in ("_key", "_url", "_body"))):
                payload = (html or "").encode()
                own = "" if page is None else f"{KEY_HEADER}: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                moment = EPOCH + dt.timedelta(seconds=(page or 0) % 10**9)
                held.append((page, address or "-", moment, head + payload))
                size += len(payload)
                if size >= file_bytes:
                    yield closed()
                    held, size, count = [], 0, count + 1
        if held:
            yield closed()

    chosen = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("_url"), F.col(body).alias("_body"))
    return chosen.mapInArrow(work, "path string, content binary")


def parse_arc(path: str, data: bytes) -> Iterator[tuple]:
    """(place, fields, content) of every record after the version block."""
    if not data:
        return
    line_end = data.find(b"\n")
    first = data[:line_end].decode("utf-8", "replace").split(" ")
    if line_end < 0 or not first[0].startswith("filedesc:") or not first[-1].isdigit():
        raise ValueError(f"{path}: no version block")
    block = data[line_end + 1 : line_end + 1 + int(first[-1])]
    version = int(block.split(b" ", 1)[0]) if block[:1].isdigit() else 0
    if version not in FIELDS or len(first) != len(FIELDS[version]):
        raise ValueError(f"{path}: unknown version")
    at = line_end + 1 + int(first[-1])
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        line_end = data.find(b"\n", at)
        values = data[at:line_end].decode("utf-8", "replace").rstrip("\r").split(" ") if line_end > 0 else []
        if len(values) != len(FIELDS[version]) or not values[-1].isdigit():
            raise ValueError(f"{path}: bad record header at {at}")
        start, length = line_end + 1, int(values[-1])
        if start + length > len(data):
            raise ValueError(f"{path}: record at {at} is cut off")
        yield at, dict(zip(FIELDS[version], values)), data[start : start + length]
        at = start + length


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def arc_to_records(archives: DataFrame) -> DataFrame:
    """ARC files (path, content), plain or gzipped, as WARC record fields.

    HTTP responses are ``response`` records whose payload is the body; other
    contents are ``resource`` records.
    """

    def convert(path: str, data: bytes) -> Iterator[tuple]:
        for place, fields, content in parse_arc(path, inflate(data)):
            is_http = content.startswith(b"HTTP/")
            cut = content.find(END) + len(END) if is_http and END in content else 0
            payload = content[cut:]
            found = digest(payload)
            moment = dt.datetime.strptime(fields["date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S")
            page = _header(content[:cut], KEY_HEADER)
            name = "\n".join((fields["url"], fields["date"], found, page or "", path, str(place)))
            yield (
                path,
                place,
                "response" if cut else "resource",
                fields["url"],
                fields["ip"],
                moment.strftime("%Y-%m-%dT%H:%M:%SZ"),
                f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
                found,
                len(payload),
                int(page) if page and re.fullmatch(r"-?\d+", page) else None,
                content[:cut],
                payload,
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(convert(path, data or b""))
                if rows:
                    yield _batch(rows, RECORDS)

    return archives.select("path", "content").mapInArrow(work, RECORDS)


def inflate(data: bytes) -> bytes:
    """Every member of gzipped data, or the data itself."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts) if parts else data


# -- WARC ---------------------------------------------------------------------


def mark_revisits(records: DataFrame, least_bytes: int = 0, salts: int = 16) -> DataFrame:
    """``records`` with revisits of equal payloads marked, and ``refers_to_id``.

    Only digests that occur twice or more are joined back.  One payload may
    hold a third of all records, so rows are salted by their record id and the
    few joined columns are repeated for every salt.
    """
    light = records.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_key"), F.col("record_id"))
    kept = light.groupBy("payload_digest").agg(F.max(order).alias("kept"), F.count("*").alias("n")).where("n > 1")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    kept = kept.select(F.col("payload_digest"), "kept", salt)
    rows = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    joined = rows.join(kept, ["payload_digest", "salt"], "left")
    lower = F.coalesce(F.col("page_key") < F.col("kept.page_key"), F.col("kept.page_key").isNotNull() & F.col("page_key").isNull())
    unkeyed = F.col("kept.page_key").isNull() & (F.col("record_id") != F.col("kept.record_id"))
    revisit = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes) & F.coalesce(lower | unkeyed, F.lit(False))
    marked = {"warc_type": F.when(revisit, F.lit("revisit")).otherwise(F.col("warc_type")), "refers_to_id": F.when(revisit, F.col("kept.record_id"))}
    return joined.withColumns(marked).drop("kept", "salt")


def warc_records(marked: DataFrame) -> DataFrame:
    """Serialised WARC records, without the blank lines that end them: (record)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_serialise(r) for r in batch.to_pylist()], pa.binary())], ["record"])

    return marked.drop("file", "place").mapInArrow(work, "record binary")


def _serialise(r: dict) -> bytes:
    block = r["head"] if r["warc_type"] == "revisit" else r["head"] + r["payload"]
    kind = {"response": "application/http; msgtype=response", "revisit": "application/http; msgtype=response"}
    lines = [
        "WARC/1.0",
        f"WARC-Type: {r['warc_type']}",
        f"WARC-Target-URI: {r['uri']}",
        f"WARC-Date: {r['date']}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {kind.get(r['warc_type'], 'application/octet-stream')}",
        f"Content-Length: {len(block)}",
    ]
    if r["warc_type"] == "revisit":
        lines[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {r['refers_to_id']}"]
    return "\r\n".join(lines).encode() + END + block


def write_warc(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    """Serialised records as gzipped WARC files of at most about ``file_bytes`` before compression.

    A file holds the records of one row, joined here; a record longer than the
    bound has a file of its own.  Spark's own text writer puts the closing blank
    lines after the last one, so the files may lie in any store that Spark can
    write to, and a task that is run again writes its files again.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for record in batch.column("record"):
                raw = record.as_py()
                if held and size + len(raw) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["record"])
                    held, size = [], 0
                held.append(raw)
                size += len(raw) + len(END)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["record"])

    writer = records.mapInArrow(joined, "record binary").select(F.col("record").cast("string")).write
    writer.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(path: str, data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record, by the declared lengths."""
    at = 0
    while at < len(data):
        cut = data.find(END, at)
        length = _header(data[at:cut], "Content-Length") if cut > 0 and data.startswith(b"WARC/", at) else None
        if length is None or not length.isdigit():
            raise ValueError(f"{path}: bad record at {at}")
        start = cut + len(END)
        end = start + int(length)
        if data[end : end + len(END)] != END:
            raise ValueError(f"{path}: record at {at} does not end where it declares")
        yield data[at:cut], data[start:end]
        at = end + len(END)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all WARC files under ``path``; digests are verified.

    A revisit's payload is not in the archive: its digest and length are those
    that it declares.  Memory follows the largest file, which :func:`write_warc` bounds.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [_record(name, head, block, payload) for head, block in parse_warc(name, inflate(data))]
                if rows:
                    yield _batch(rows, READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(work, READ)


def _record(name: str, head: bytes, block: bytes, payload: bool) -> tuple:
    kind, declared = _header(head, "WARC-Type"), (_header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    if _header(head, "WARC-Block-Digest") != f"sha1:{digest(block)}":
        raise ValueError(f"{name}: block digest differs")
    cut = block.find(END) + len(END) if block.startswith(b"HTTP/") and END in block else 0
    page = _header(block[:cut], KEY_HEADER)
    if kind == "revisit":
        body, size = None, int(_header(block[:cut], "Content-Length") or 0)
    else:
        body, size = block[cut:], len(block) - cut
        if digest(body) != declared:
            raise ValueError(f"{name}: payload digest differs")
    return (
        kind,
        _header(head, "WARC-Target-URI"),
        _header(head, "WARC-Date"),
        _header(head, "WARC-Record-ID"),
        _header(head, "WARC-Refers-To"),
        declared,
        size,
        int(page) if page and re.fullmatch(r"-?\d+", page) else None,
        body if payload else None,
    )
