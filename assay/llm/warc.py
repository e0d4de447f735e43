"""WARC archives: a writer that stores repeated payloads once, and a salvage reader.

The writer makes one gzip member per record and separates members by a zero byte,
which gzip readers skip as padding. The reader tests every member and record
(gzip checksum, version line, header, lengths, block digest). After a failed test
it goes on at the next member that opens or the next version line that parses,
and logs the bytes between as a gap, with the reason.

* A null html is an empty payload. Of records with equal payloads of at least
  `least_bytes` the smallest page_id is the response, all others are revisits
  without payload; shorter ones are responses. Rows with that smallest page_id
  are all responses. A null page_id is larger than others.
* An archive has `per_archive` records at most, and is read by one task.
* Pages keep no other columns; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import shared_folder

LEAST_BYTES = 100
PER_ARCHIVE = 1000
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
ANY_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r$")
PIECE = 1 << 16

RECORD = (
    "file string, start long, size long, record_id string, record_type string, url string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary, "
    "gap_reason string"
)
NAMES = [field.split()[0] for field in RECORD.split(", ")]


# Writing


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with payload_bytes, payload_digest, record_type and refers_to."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    firsts = (
        known.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    first = F.col("first_id")
    again = first.isNotNull() & ~first.eqNullSafe(F.col("page_id"))
    return known.join(firsts, "payload_digest", "left").select(
        *known.columns,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, first).alias("refers_to"),
    )


def line_safe(value: str) -> str:
    """A header value on one line; percent signs and line ends as in urls."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(
    name: str,
    kind: str,
    url: str | None,
    payload: bytes,
    digest: str,
    payload_bytes: int,
    refers_to: str | None = None,
) -> bytes:
    """One WARC record, separators at its end included."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {line_safe(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <{refers_to}>"] if refers_to is not None else []),
        *(
            ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            if kind == "revisit"
            else []
        ),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {payload_bytes}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    head = VERSION + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return head + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_archives(plan: DataFrame, folder: str, per_archive: int = PER_ARCHIVE) -> None:
    """Write `planned` pages below `folder`, a place that Spark can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice at a time: pages may be long.
            for first in range(0, len(batch), 200):
                out = []
                for row in batch.slice(first, 200).to_pylist():
                    refers = row["refers_to"]
                    made = record(
                        f"urn:page:{row['page_id']}",
                        row["record_type"],
                        row["url"],
                        row["html"].encode(),
                        row["payload_digest"],
                        row["payload_bytes"],
                        None if refers is None else f"urn:page:{refers}",
                    )
                    out.append(member(made))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # A string column passes bytes through as they are.
    members = plan.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_archive).text(folder)


# Reading


def fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def one_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at a place: where it ends, header fields, block; or why it is none."""
    version = ANY_VERSION.match(data, at)
    if not version:
        return "no version line"
    ends = data.find(b"\r\n\r\n", at)
    if ends < 0:
        return "header without an end"
    head = data[version.end() : ends + 2]
    if b"\n" + VERSION[:7] in head:
        return "header cut off by another record"
    length = LENGTH.search(head)
    if not length:
        return "header without a length"
    first = ends + 4
    last = first + int(length[1])
    if data[last : last + 4] != b"\r\n\r\n":
        return "block without its end"
    found = fields(head)
    kind, _, digest = found.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(memoryview(data)[first:last]).hexdigest() != digest:
        return "block digest differs"
    return last + 4, found, data[first:last]


def records(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(start, size, record or reason of a gap) of uncompressed bytes."""
    at = 0
    while at < len(data):
        got = one_record(data, at)
        if isinstance(got, str):
            following = ANY_VERSION.search(data, at + 1)
            while following and isinstance(one_record(data, following.start()), str):
                following = ANY_VERSION.search(data, following.start() + 1)
            end = following.start() if following else len(data)
            yield at, end - at, got
            at = end
        else:
            yield at, got[0] - at, got[1:]
            at = got[0]


def one_member(data: bytes, at: int) -> tuple[int, bytes] | str:
    """The gzip member at a place: where it ends and what it holds; or why it is none."""
    if data[at : at + 3] != MAGIC:
        return "no gzip member"
    squeeze = zlib.decompressobj(31)
    parts, view = [], memoryview(data)
    try:
        while at < len(data) and not squeeze.eof:
            parts.append(squeeze.decompress(view[at : at + PIECE]))
            at += PIECE
    except zlib.error as wrong:
        return f"gzip: {wrong}"
    if not squeeze.eof:
        return "gzip member without an end"
    return min(at, len(data)) - len(squeeze.unused_data), b"".join(parts)


def salvaged(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(start, size, record or reason of a gap) of an archive, compressed or not.

    Places are those in the file; records inside a member have the member's place.
    """
    if not data.startswith(MAGIC) and MAGIC not in data:
        yield from records(data)
        return
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding between members
            at += 1
            continue
        got = one_member(data, at)
        if isinstance(got, str):
            if ANY_VERSION.match(data, at) and not isinstance(one := one_record(data, at), str):
                yield at, one[0] - at, one[1:]
                at = one[0]
                continue
            end = _next_valid(data, at + 1)
            yield at, end - at, got
            at = end
        else:
            for _start, _size, what in records(got[1]):
                yield at, got[0] - at, what
            at = got[0]


def _next_valid(data: bytes, at: int) -> int:
    """Where the next member that opens or record that parses begins, else the end."""
    while True:
        gz, version = data.find(MAGIC, at), ANY_VERSION.search(data, at)
        places = [p for p in (gz, version.start() if version else -1) if p >= 0]
        if not places:
            return len(data)
        at = min(places)
        opened = one_member(data, at) if at == gz else one_record(data, at)
        if not isinstance(opened, str):
            return at
        at += 1


def payload_of(block: bytes) -> bytes:
    """What follows an HTTP header, or the block."""
    if block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A row per record or gap of the archives in a folder: see RECORD.

    A row with `gap_reason` is a gap. The payload of a revisit is null; its length and
    digest are those of the record it refers to. Payload digests are tested too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for start, size, what in salvaged(data):
            if isinstance(what, str):
                yield (path, start, size, *[None] * 7, what)
                continue
            head, block = what
            kind = head.get("warc-type")
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
            named = head.get("warc-record-id", "").strip("<>")
            url = head.get("warc-target-uri")
            refers = head.get("warc-refers-to")
            length = head.get("warc-payload-length", "")
            payload = None if kind == "revisit" else payload_of(block)
            if payload is not None:
                real = hashlib.sha256(payload).hexdigest()
                if digest is not None and len(digest) == 64 and digest != real:
                    yield (path, start, size, *[None] * 7, "payload digest differs")
                    continue
                digest, count = real, len(payload)
            else:
                count = int(length) if length.isdigit() else None
            yield (
                path,
                start,
                size,
                named,
                kind,
                None if url is None else plain(url),
                None if refers is None else refers.strip("<>"),
                count,
                digest,
                payload,
                None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
        types += [pa.binary(), pa.string()]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, NAMES)

        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                for row in rows(path.as_py(), data.as_py()):
                    held.append(row)
                    if len(held) == 200:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives and read them back: see RECORD."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    write_archives(planned(pages), folder)
    return read_archives(spark, folder)
