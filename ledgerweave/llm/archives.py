"""Legacy web archives (ARC, versions 1 and 2) converted to WARC.

An ARC file opens with a version block that names the fields of the header lines after it;
each record is a header line, as many bytes as it declares, and a newline. The converter
reads fields by version and content by declared length, and synthesises what WARC wants and
ARC lacks: a record identifier (a name-based UUID of what identifies the capture), an ISO
timestamp, a record type (warcinfo for the version block, response for HTTP, resource for
the rest, revisit for a payload that another record holds) and SHA-1 digests of block and
payload.

Files are written by Spark's text sink and read by its binary source, so they can lie in any
store that Spark reaches. A file holds at most ``file_records`` records, so that reading one
takes bounded memory.

Defined cases: a null html is an empty payload; blanks in a URL are percent-encoded and a
null or empty one is written as ``about:blank``; a null page_id is not written and read back
as null. Of records with equal payloads (digest and length) of at least ``least_bytes`` the
one with the smallest page_id is the response, null coming last; rows that repeat it are
responses too. A file that ends within a record is an error. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable, fresh_path

FILE_RECORDS = 4_000
CAPTURED = "20000101000000"

# The names of the header fields, by version of the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL",
        "IP-address",
        "Archive-date",
        "Content-type",
        "Result-code",
        "Checksum",
        "Location",
        "Offset",
        "Filename",
        "Archive-length",
    ),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 ledgerweave\n{' '.join(ARC_FIELDS[version])}\n".encode()
    plain = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Content-type": "text/plain"}
    return header_line(version, plain, CAPTURED, len(body)) + body


def header_line(version: int, given: dict[str, str], date: str, length: int) -> bytes:
    fields = given | {"Archive-date": date, "Archive-length": str(length)}
    return (" ".join(fields.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if page_id is not None:
        head.append(PAGE_HEADER + b": %d" % page_id)
    content = b"\r\n".join(head) + b"\r\n\r\n" + payload
    safe = "".join(f"%{ord(c):02X}" if c in " \t\n\r\x0b\x0c" else c for c in url or "") or "about:blank"
    given = {"URL": safe, "IP-address": "127.0.0.1", "Content-type": "text/html", "Result-code": "200"}
    return header_line(version, given, CAPTURED, len(content)) + content


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Version, header fields and content of every record, the version block first."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "surrogateescape")
        if not version:
            # The block's own header has five fields in version 1 and ten in version 2.
            version = int(data[end + 1 : data.index(b" ", end + 1)])
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values))
        if len(values) != len(names) or not fields["Archive-length"].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        length = int(fields["Archive-length"])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"the archive ends within a record of {length} bytes")
        yield version, fields, content
        at = end + 1 + length


def warc_date(arc_date: str) -> str:
    """14 digits, or fewer from the left, as an ISO timestamp."""
    whole = (arc_date + CAPTURED[len(arc_date) :])[:14]
    return datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def converted(version: int, fields: dict[str, str], content: bytes) -> dict:
    """What a WARC record needs, out of an ARC record."""
    url = fields["URL"]
    if url.startswith("filedesc:"):
        kind, head, payload = "warcinfo", b"", content
    elif content.startswith(b"HTTP/"):
        head, _, payload = content.partition(b"\r\n\r\n")
        kind = "response"
    else:
        kind, head, payload = "resource", b"", content
    digest = sha1_base32(payload)
    page = next((v for k, v in http_headers(head) if k == PAGE_HEADER.lower()), None)
    name = f"{url} {fields['Archive-date']} {page} {digest} {len(payload)}"
    return {
        "kind": kind,
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}",
        "url": url,
        "ip": fields["IP-address"],
        "date": warc_date(fields["Archive-date"]),
        "media": fields["Content-type"],
        "page_id": None if page is None else int(page),
        "head": head,
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_digest": digest,
    }


def http_headers(head: bytes) -> Iterator[tuple[bytes, bytes]]:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        yield name.strip().lower(), value.strip()


def warc_record(record: dict, refers_to: str | None) -> bytes:
    """A WARC record without the last newline, which the text sink adds."""
    kind = "revisit" if refers_to else record["kind"]
    if kind == "revisit":
        block = record["head"] + b"\r\n\r\n"
    elif kind == "response":
        block = record["head"] + b"\r\n\r\n" + record["payload"]
    else:
        block = record["payload"]
    media = {
        "warcinfo": "application/warc-fields",
        "resource": record["media"],
    }.get(kind, "application/http;msgtype=response")
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record['record_id']}>",
        f"WARC-Date: {record['date']}",
    ]
    if kind != "warcinfo":
        lines += [
            f"WARC-Target-URI: {record['url']}",
            f"WARC-IP-Address: {record['ip']}",
            f"WARC-Payload-Digest: sha1:{record['payload_digest']}",
        ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {media}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of every record, by declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:200]!r}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the archive ends within a record of {length} bytes")
        yield fields, block
        at = end + 4 + length + 4


def _sunk(records: DataFrame, path: str, file_records: int) -> None:
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", file_records)
        .option("compression", "gzip")
        # Deflating is most of the work; the fastest level costs little space.
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


def _one(record: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])


def write_arc(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes page_id, url and html as ARC files, of version 1 and 2 in turn."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, version = 0, 2
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                if written % file_records == 0:
                    version = 3 - version
                    yield _one(version_block(version, f"pages-{written // file_records}.arc"))
                    written += 1
                yield _one(arc_record(version, page_id.as_py(), url.as_py(), html.as_py()))
                written += 1

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    _sunk(rows.mapInArrow(lay, "record binary"), path, file_records)


_FIELDS = (
    ("kind", "string"),
    ("record_id", "string"),
    ("url", "string"),
    ("ip", "string"),
    ("date", "string"),
    ("media", "string"),
    ("page_id", "long"),
    ("head", "binary"),
    ("payload", "binary"),
    ("payload_bytes", "long"),
    ("payload_digest", "string"),
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
# Bytes of content that leave a task at a time.
_BATCH_BYTES = 4 << 20


def read_arc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The records of ARC files, plain or compressed, as ``converted`` gives them; without
    ``content`` head and payload are left out."""
    fields = [f for f in _FIELDS if content or f[0] not in ("head", "payload")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                held, size = [], 0
                for record in arc_records(unzipped(file.as_buffer().to_pybytes())):
                    held.append(converted(*record))
                    size += held[-1]["payload_bytes"]
                    if size > _BATCH_BYTES:
                        yield _rows(held, fields)
                        held, size = [], 0
                if held:
                    yield _rows(held, fields)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, ", ".join(f"{n} {t}" for n, t in fields))


def _rows(records: list[dict], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in records], _ARROW[t]) for n, t in fields], names=[n for n, _ in fields]
    )


def arc_to_warc(
    spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS
) -> None:
    """Converts ARC files to WARC files, with revisit records for repeated payloads."""
    captures = durable(
        read_arc(spark, arc_path, content=False)
        .where("kind = 'response'")
        .select("record_id", "page_id", "payload_bytes", "payload_digest"),
        "captures",
    )
    same = ["payload_digest", "payload_bytes"]
    firsts = captures.groupBy(*same).agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"),
    )
    # Payloads that occur once need no decision; the table has the revisits only, and its
    # size on disk is what Spark goes by in choosing how to join it.
    revisits = durable(
        captures.join(firsts.where("n > 1").hint("merge"), same)
        .where((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
        .select(F.col("record_id").alias("revisit_id"), F.col("first.record_id").alias("refers_to"))
        .distinct(),
        "revisits",
    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                record = {n: batch.column(n)[i].as_py() for n in names}
                if written % file_records == 0:
                    yield _one(_info(written // file_records))
                    written += 1
                yield _one(warc_record(record, record["refers_to"]))
                written += 1

    records = (
        read_arc(spark, arc_path)
        .where("kind <> 'warcinfo'")
        .join(revisits, F.col("record_id") == F.col("revisit_id"), "left")
        .drop("revisit_id")
    )
    _sunk(records.mapInArrow(lay, "record binary"), warc_path, file_records)


def _info(number: int) -> bytes:
    body = b"software: ledgerweave\r\nformat: WARC File Format 1.0\r\n"
    record = {
        "kind": "warcinfo",
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {number}')}",
        "date": warc_date(CAPTURED),
        "payload": body,
        "media": "",
    }
    return warc_record(record, None)


_CAPTURE = (
    "record_id string, record_type string, url string, date string, page_id long, "
    "payload_bytes long, payload_digest string, refers_id string"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures in WARC files. The digest of a response is computed from its payload
    and must be the declared one; a revisit's payload is that of the record it refers to.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for fields, block in warc_records(unzipped(file.as_buffer().to_pybytes())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
                    declared = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and sha1_base32(payload) != declared:
                        raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
                    page = next((v for k, v in http_headers(head) if k == PAGE_HEADER.lower()), None)
                    rows.append(
                        (
                            fields["warc-record-id"].strip("<>"),
                            kind,
                            fields["warc-target-uri"],
                            fields["warc-date"],
                            None if page is None else int(page),
                            None if kind == "revisit" else len(payload),
                            declared,
                            fields.get("warc-refers-to", "").strip("<>") or None,
                        )
                    )
                if rows:
                    types = (pa.string(),) * 4 + (pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                        names=[f.split()[0] for f in _CAPTURE.split(", ")],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _CAPTURE)


def round_trip(pages: DataFrame, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> DataFrame:
    """Writes the pages as ARC files, converts them to WARC files and reads these: per
    page page_id, url, date, payload_bytes, payload_digest, record_type and refers_to, the
    page_id of the response that a revisit refers to."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, file_records)
    arc_to_warc(spark, arc, warc, least_bytes, file_records)
    captures = durable(read_warc(spark, warc), "warc-captures")
    responses = captures.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("held_id")).agg(
        F.min("page_id").alias("held_page"), F.min("payload_bytes").alias("held_bytes")
    )
    return captures.join(
        responses.hint("merge"), F.coalesce("refers_id", "record_id") == F.col("held_id"), "left"
    ).select(
        "page_id",
        "url",
        "date",
        F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("held_page")).alias("refers_to"),
    )
