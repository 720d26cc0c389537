"""WARC records in ZIP-packaged archives: writing, and reading records by range.

An archive is a ZIP file whose members are stored without compression::

    archive/data.warc.gz     one gzip member per WARC record
    indexes/index.cdxj       per record a line of JSON: id, type, offset, length

The reader takes the member positions from the central directory (ZIP64 where needed) and
reads records out of the ZIP file by their offsets; nothing is extracted.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringfold.workdir import stored, work_dir

DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT_BYTES = 1000
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 2 << 20
_DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:page:%s>"
_EOCD = struct.Struct("<4s4H2LH")
_EOCD64 = struct.Struct("<4sQ2H2L4Q")
_LOCATOR64 = struct.Struct("<4sLQL")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_MOST_COMMENT = 65_535


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


class ZipDirectory:
    """The central directory of a ZIP file that is read by ranges."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        start = max(0, size - _EOCD.size - _MOST_COMMENT)
        tail = self.range(start, size - start)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("not a ZIP file")
        _, _, _, _, entries, length, offset, _ = _EOCD.unpack_from(tail, at)
        if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            place = start + at - _LOCATOR64.size
            magic, _, end64, _ = _LOCATOR64.unpack(self.range(place, _LOCATOR64.size))
            if magic != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            fields = _EOCD64.unpack(self.range(end64, _EOCD64.size))
            if fields[0] != b"PK\x06\x06":
                raise ValueError("ZIP64 directory end is missing")
            entries, length, offset = fields[7:10]
        self.members = {m.name: m for m in self._entries(self.range(offset, length), entries)}

    def range(self, start: int, length: int) -> bytes:
        self._source.seek(start)
        return self._source.read(length)

    @staticmethod
    def _entries(data: bytes, n: int) -> Iterator[Member]:
        at = 0
        for _ in range(n):
            f = _ENTRY.unpack_from(data, at)
            if f[0] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            method, size, n_name, n_extra, n_comment, header = f[4], f[9], f[10], f[11], f[12], f[16]
            packed = f[8]
            at += _ENTRY.size
            name = data[at : at + n_name].decode("utf-8", "replace")
            extra = data[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + length :]
            yield Member(name, method, size, header)

    def data_start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed as a whole; its records cannot be read by range")
        f = _LOCAL.unpack(self.range(member.header, _LOCAL.size))
        if f[0] != b"PK\x03\x04":
            raise ValueError("local header is damaged")
        return member.header + _LOCAL.size + f[9] + f[10]

    def read(self, name: str) -> bytes:
        return self.range(self.data_start(name), self.members[name].size)


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID % ('' if page_id is None else page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        headers.append(f"WARC-Refers-To: {_ID % refers_to}")
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_revisit_bytes: int = LEAST_REVISIT_BYTES,
) -> DataFrame:
    """Write a WARC record per page; returns the stored list of archives: ``path, n_records``.

    Of pages with equal payloads of at least ``least_revisit_bytes``, the one with the
    largest id is a response and the others are revisits of it; rows that repeat the
    largest id are responses too. A null payload is empty, a null id counts as the
    smallest and is never referred to. Other columns are not read; an empty table gives
    an empty list.

    Payloads are compared by SHA-1 and length; their counts are combined before the
    shuffle, and a payload of a large share of all pages is a skewed join, which Spark
    splits. Each task writes one archive under a name of its own and lists it.
    """
    base = work_dir(pages.sparkSession, "archives")
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    repeated = rows.where(F.col("size") >= least_revisit_bytes).groupBy("digest", "size")
    repeated = repeated.agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select("digest", "size", "target"), "repeated-payloads")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to")
    records = rows.join(repeated, ["digest", "size"], "left").select("page_id", "url", "payload", "digest", refers_to)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        index: list[bytes] = []
        at = 0
        for batch in batches:
            if out is None and batch.num_rows:
                system, folder = fs.FileSystem.from_uri(base)
                system.create_dir(folder, recursive=True)
                name = f"{uuid.uuid4().hex}.zip"
                out = system.open_output_stream(f"{folder}/{name}")
                packed = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = packed.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True)
            for page_id, url, body, digest, target in zip(*batch.columns, strict=True):
                page, ref = page_id.as_py(), target.as_py()
                record = _record(page, url.as_py(), body.as_py(), digest.as_py(), ref)
                data.write(record)
                kind = "response" if ref is None else "revisit"
                line = {"id": page, "type": kind, "offset": at, "length": len(record)}
                index.append(json.dumps(line, separators=(",", ":")).encode())
                at += len(record)
        if out is not None:
            data.close()
            packed.writestr(zipfile.ZipInfo(INDEX_MEMBER), b"\n".join(index))
            packed.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{base}/{name}"], "n_records": [len(index)]})

    return stored(records.mapInArrow(write, "path string, n_records bigint"), "archive-list")


_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_length", pa.int64()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _parse(packed: bytes) -> tuple:
    """A record's fields in the order of ``_RECORD``; a revisit has no payload."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    return (
        fields["WARC-Record-ID"],
        kind,
        fields.get("WARC-Target-URI"),
        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        int(fields["X-Payload-Length"]),
        fields.get("WARC-Refers-To"),
        block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
    )


def _ranges(entries: list[dict]) -> Iterator[list[dict]]:
    """Index entries in order of offset, in groups that lie together."""
    group: list[dict] = []
    for e in sorted(entries, key=lambda e: e["offset"]):
        if group and e["offset"] + e["length"] - group[0]["offset"] > READ_BYTES:
            yield group
            group = []
        group.append(e)
    if group:
        yield group


def read_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """All records of the archives at the given paths: the columns of ``_RECORD``.

    A task holds an archive's index and about ``READ_BYTES`` of records at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    directory = ZipDirectory(source)
                    start = directory.data_start(DATA_MEMBER)
                    index = [json.loads(line) for line in directory.read(INDEX_MEMBER).splitlines()]
                    for group in _ranges(index):
                        low, last = group[0]["offset"], group[-1]
                        data = directory.range(start + low, last["offset"] + last["length"] - low)
                        rows = [_parse(data[e["offset"] - low : e["offset"] - low + e["length"]]) for e in group]
                        columns = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD
                        )

    n = max(1, archives.count())
    fields = "record_id string, record_type string, target_uri string, payload_digest string"
    return (
        archives.select(path_col)
        .repartition(n)
        .mapInArrow(read, f"{fields}, payload_length bigint, refers_to string, payload binary")
    )


def page_records(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are computed from its payload, those of a revisit are
    in its header.
    """

    def page(column: str):
        return F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1).try_cast("bigint")

    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


ARCHIVE_SQL = """
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), grouped AS (
  SELECT *, count(*) OVER (PARTITION BY payload_digest, payload_bytes) AS n,
    max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target
  FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM target AND target IS NOT NULL
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM grouped
"""
