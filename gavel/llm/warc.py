"""Legacy ARC archives to WARC, and WARC archives as gzip files in the shared folder.

ARC records are a header line and as many bytes as it declares. The line has five fields in version
1 and ten in version 2; the version block at the head of an archive tells which. A record becomes a
WARC record with an identifier made from its contents, an ISO timestamp, a type from its scheme
and contents, and SHA-1 digests of its block and payload. Records with equal payloads are written
once: the one with the largest source id is the response, the others revisit it.

Archives are byte streams for the parsers, which take them in pieces of any size and hold one record
at a time. Spark's text source reads files piece by piece and its sink writes them, so any file
system works, and a lost task writes its file again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gavel.llm.common import scratch_path, stored

#: Date of records made from pages, which carry none.
PAGE_DATE = "20240101000000"

# Field lists of the two versions of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: (
        "URL IP-address Archive-date Content-type Result-code "
        "Checksum Location Offset Filename Archive-length"
    ),
}
_ID_HEADER = "X-Source-Id"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    status: str | None  # version 2 only
    block: bytes
    error: str | None = None


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, ip: str = "0.0.0.0") -> bytes:
    """One ARC record; white space in the URL is escaped, as it would end the field."""
    url = "".join(c if not c.isspace() else f"%{ord(c):02X}" for c in url) or "-"
    extra = "" if version == 1 else " 200 - - 0 -"
    return f"{url} {ip} {date} {kind}{extra} {len(block)}\n".encode() + block + b"\n"


def arc_header(version: int, name: str, date: str = PAGE_DATE) -> bytes:
    """The version block that an archive starts with."""
    block = f"{version} 0 gavel\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", block)[:-1]


class ArcReader:
    """Parses an ARC byte stream that comes in pieces.

    A header line that doesn't parse ends the reading of its archive: without a length, nothing
    tells where the next record starts. It is given as a record with an error.
    """

    def __init__(self) -> None:
        self._data = bytearray()
        self._version = 1
        self._broken = False

    def feed(self, piece: bytes) -> Iterator[ArcRecord]:
        if self._broken:
            return
        self._data += piece
        at = 0
        while True:
            while at < len(self._data) and self._data[at] in b"\r\n":
                at += 1  # the separator after a record
            end = self._data.find(b"\n", at)
            if end < 0:
                break
            line = bytes(self._data[at:end]).decode("utf-8", "replace").rstrip("\r")
            fields = line.split(" ")
            if line.startswith("filedesc://"):
                # The version block names its own version, so its line has either length.
                self._version = 1 if len(fields) == 5 else 2
            wanted = 5 if self._version == 1 else 10
            if len(fields) < wanted or not fields[-1].isdigit():
                self._broken = True
                yield ArcRecord("", "", "", "", None, b"", f"bad header line: {line[:200]}")
                self._data.clear()
                return
            length = int(fields[-1])
            if len(self._data) < end + 1 + length:
                break
            block = bytes(self._data[end + 1 : end + 1 + length])
            at = end + 1 + length
            tail = fields[-(wanted - 1) :]
            url = " ".join(fields[: -(wanted - 1)])
            status = tail[3] if self._version == 2 else None
            yield ArcRecord(url, tail[0], tail[1], tail[2], status, block)
        del self._data[:at]

    @property
    def waiting(self) -> bool:
        """Whether a record has begun whose end has not come."""
        return bool(self._data)

    def close(self) -> Iterator[ArcRecord]:
        """At the end of the stream: a record that is cut short is given as an error."""
        if self._data.strip(b"\r\n"):
            line = bytes(self._data).partition(b"\n")[0].decode("utf-8", "replace")
            yield ArcRecord("", "", "", "", None, b"", f"record cut short: {line[:200]}")
        self._data.clear()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """Fourteen or fewer digits to an ISO timestamp; missing parts are their first."""
    full = (date + "00000101000000"[len(date) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers in lower case, payload) of an HTTP response, None for another block."""
    if not block.startswith(b"HTTP/"):
        return None
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = head.decode("latin-1").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, payload


_CONVERTED = (
    "seq long, source_id long, url string, date string, warc_type string, content_type string, "
    "record_id string, block_digest string, payload_digest string, payload_bytes long, "
    "block binary, error string"
)
_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary(), pa.string()]


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def converted(record: ArcRecord, seq: int) -> tuple:
    """A row of ``arc_to_warc`` for one ARC record."""
    if record.error:
        return (seq, *[None] * 9, b"", record.error)
    http = split_http(record.block)
    payload = record.block if http is None else http[1]
    source = (http[0].get(_ID_HEADER.lower()) if http else None) or ""
    if record.url.startswith("filedesc://"):
        kind, content_type = "warcinfo", "application/warc-fields"
    elif http is not None:
        kind, content_type = "response", "application/http; msgtype=response"
    else:
        kind, content_type = "resource", record.content_type
    payload_digest = digest(payload)
    name = f"{record.url} {record.date} {payload_digest} {source} {seq}"
    return (
        seq,
        int(source) if source.lstrip("-").isdigit() else None,
        record.url,
        iso_date(record.date),
        kind,
        content_type,
        f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}",
        digest(record.block),
        payload_digest,
        len(payload),
        record.block,
        None,
    )


def pages_to_arc(pages: DataFrame, version: int = 1, date: str = PAGE_DATE) -> DataFrame:
    """(seq, archive): ARC archives of (page_id, url, html), one for each batch of rows.

    A page is stored as an HTTP response whose header carries its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            parts = [arc_header(version, "pages.arc", date)]
            for page_id, url, html in rows:
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if page_id is not None:
                    head += f"{_ID_HEADER}: {page_id}\r\n"
                head += f"Content-Length: {len(html)}\r\n\r\n"
                block = head.encode() + html
                parts.append(b"\n" + arc_record(version, url or "", date, "text/html", block)[:-1])
            first = batch.column("seq")[0].as_py() if batch.num_rows else 0
            yield _batch(
                [(first, b"".join(parts) + b"\n")] if batch.num_rows else [],
                [pa.int64(), pa.binary()],
                "seq long, archive binary",
            )

    return pages.select(
        F.monotonically_increasing_id().alias("seq"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).mapInArrow(run, "seq long, archive binary")


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """WARC records of archives (seq, archive): see ``_CONVERTED`` for the columns.

    Records are numbered from their archive's ``seq`` on. Version blocks become warcinfo records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archives = zip(batch.column("seq").to_pylist(), batch.column("archive").to_pylist())
            for seq, archive in archives:
                reader, rows = ArcReader(), []
                for record in reader.feed(archive or b""):
                    rows.append(converted(record, seq))
                    seq += not record.url.startswith("filedesc://")
                rows += [converted(record, seq) for record in reader.close()]
                yield _batch(rows, _KINDS, _CONVERTED)

    return archives.mapInArrow(run, _CONVERTED)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records of ARC files; a file is read as one stream, by one task.

    Spark may read a plain file in several splits, so lines are brought together by file and
    place first. A record is numbered by its header line. A line end that is missing
    at the end of a file counts as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, mark = ArcReader(), None, 0
        for batch in batches:
            rows = []
            pieces = zip(*(batch.column(c).to_pylist() for c in ("file", "seq", "piece")))
            for file, seq, piece in pieces:
                if file != current:
                    rows += [converted(record, mark) for record in reader.close()]
                    reader, current = ArcReader(), file
                if not reader.waiting:
                    mark = seq
                for record in reader.feed(piece + b"\n"):
                    rows.append(converted(record, mark))
                    mark = seq  # a header that ends in this line
            yield _batch(rows, _KINDS, _CONVERTED)
        yield _batch([converted(record, mark) for record in reader.close()], _KINDS, _CONVERTED)

    lines = spark.read.option("lineSep", "\n").text(path)
    return (
        lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").cast("binary").alias("piece"),
        )
        .repartition("file")
        .sortWithinPartitions("file", "block", "seq")
        .mapInArrow(run, _CONVERTED)
    )


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with refers_to and refers_to_id, set for revisits.

    Of response records with equal payloads of at least ``min_bytes``, that with the largest source
    id (null is smallest; then the largest seq) stays a response. Only narrow rows are grouped.
    """
    able = (F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes)
    payload = ["payload_digest", "payload_bytes"]
    narrow = records.filter(able).select("seq", "source_id", "record_id", *payload)
    most = stored(
        narrow.groupBy(*payload).agg(
            F.max(F.struct("source_id", "seq", "record_id")).alias("_most"),
            F.count(F.lit(1)).alias("_n"),
        ).filter("_n > 1"),
        "warc-payloads",
    )
    revisits = stored(
        narrow.join(most, payload)
        .filter("seq != _most.seq")
        .select(
            F.col("seq").alias("_seq"),
            F.col("_most.record_id").alias("refers_to"),
            F.col("_most.source_id").alias("refers_to_id"),
        ),
        "warc-revisits",
    )
    return records.join(revisits, F.col("seq") == F.col("_seq"), "left").drop("_seq")


def _rendered(row: dict) -> bytes:
    """A WARC record without the line ends behind it."""
    block, kind = row["block"], row["warc_type"]
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["source_id"] is not None:
        head.append(f"{_ID_HEADER}: {row['source_id']}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{row['refers_to']}>")
        head.append(
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        )
        if row["refers_to_id"] is not None:
            head.append(f"X-Refers-To-Source-Id: {row['refers_to_id']}")
        http = split_http(block)
        block = block if http is None else block[: len(block) - len(http[1])]
        head.append(f"WARC-Block-Digest: sha1:{digest(block)}")
    else:
        head.append(f"WARC-Block-Digest: sha1:{row['block_digest']}")
    head.append(f"Content-Type: {row['content_type']}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzip WARC files under ``path``, one for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_rendered(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    (
        records.filter("error is null")
        .mapInArrow(run, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


_READ = (
    "record_id string, warc_type string, url string, date string, source_id long, "
    "payload_bytes long, payload_digest string, refers_to string, refers_to_id long, block binary"
)


def _parsed(head: bytes, block: bytes) -> tuple:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
    number = lambda name: int(fields[name]) if name in fields else None
    kind = fields["warc-type"]
    said = fields.get("warc-payload-digest", "sha1:").partition(":")[2]
    size = number("x-payload-length")
    if kind != "revisit":
        http = split_http(block) if "application/http" in fields.get("content-type", "") else None
        payload = block if http is None else http[1]
        if said and digest(payload) != said:
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
        said, size = digest(payload), len(payload)
    refers = fields.get("warc-refers-to")
    return (
        fields["warc-record-id"].strip("<>"),
        kind,
        fields.get("warc-target-uri"),
        fields.get("warc-date"),
        number(_ID_HEADER.lower()),
        size,
        said,
        refers.strip("<>") if refers else None,
        number("x-refers-to-source-id"),
        block,
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of gzip WARC files, by their declared lengths; payload digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, head, length = bytearray(), None, 0
        kinds = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for piece in batch.column("piece").to_pylist():
                data += piece + b"\r\n\r\n"
                while True:
                    if head is None:
                        # Line ends between records; a file's last ones may be given twice.
                        while data[:2] == b"\r\n":
                            del data[:2]
                        end = data.find(b"\r\n\r\n")
                        if end < 0:
                            break
                        head = bytes(data[:end])
                        del data[: end + 4]
                        declared = [
                            line.partition(b":")[2]
                            for line in head.split(b"\r\n")
                            if line.lower().startswith(b"content-length:")
                        ]
                        length = int(declared[0])
                    if len(data) < length + 4:
                        break
                    rows.append(_parsed(head, bytes(data[:length])))
                    del data[: length + 4]
                    head = None
            yield _batch(rows, [*kinds, pa.binary()], _READ)

    pieces = spark.read.option("lineSep", "\r\n\r\n").text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece")).mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC into WARC files in the shared folder, and the records read back.

    Defined cases: a null html is the empty payload, a null url is ``-``, a null id has no id; empty
    payloads are equal like others; repeated rows are records of their own, of which all but one
    are revisits; an empty table gives an empty archive and no rows; other columns are not read.
    """
    spark = pages.sparkSession
    records = stored(
        arc_to_warc(pages_to_arc(pages, version)).filter("warc_type != 'warcinfo'"), "warc-records"
    )
    path = scratch_path(spark, "warc")
    write_warc(mark_revisits(records, min_bytes), path)
    return read_warc(spark, path)
