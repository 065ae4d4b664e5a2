"""WARC records in ZIP archives, written and range-read back.

Each archive is a ZIP file of stored members: ``archive/data.warc.gz`` with one gzip
member per record, and ``indexes/index.cdxj`` with a line per record (place and size).
The reader needs no extraction: it finds the end record of the ZIP file (the ZIP64
one where fields overflow), parses the central directory, locates a member through its
local header, reads the index, and then reads ranges of records.

Of records with equal payloads, that with the largest page id is a ``response`` with the
payload; the others are ``revisit`` records that name it, whose block holds the HTTP
headers only.

Defined results: null html is an empty payload and null url an empty target; a null page
id revisits like any other, unless its group has no other id (then all are responses);
rows repeated with the largest id of their group are responses each; an empty table
gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, open_filesystem, shared_folder, shuffle_partitions, stage

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"  # crawl times are not part of the table
# fixed values of the formats
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def of_urn(value: str):
    name = value[len("<urn:page:"):-1]
    return None if name == "none" else int(name)


def record(row: dict) -> bytes:
    """The WARC record of a page: response, or revisit if ``refers_to`` is set."""
    payload = (row["html"] or "").encode()
    revisit = row["is_revisit"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    target = "".join(c for c in row["url"] or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(row['page_id'])}",
            f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(row['sha1']).decode()}"]
    if revisit:
        head += [f"WARC-Refers-To: {urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Page id, payload size and digest, type and reference of a record; a response's
    payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.decode().split("\r\n") if line.lower().startswith("content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": of_urn(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": of_urn(refers) if refers else None}


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, sha1, is_revisit, refers_to`` of ``pages``.

    The groups are found on narrow rows (id and digest); the html moves at most once,
    when the revisits are joined to the pages by id and digest, so no group meets in
    one task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("sha1"))
    narrow = stage(rows.select("page_id", "sha1"))
    # a payload that occurs once needs no look-up
    largest = stage(narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("group_size"))
                    .where("group_size > 1"))
    revisits = stage(join_groups(narrow, largest, "sha1").distinct()
                     .where("refers_to is not null and (page_id is null or page_id <> refers_to)"))
    r = revisits.select(F.col("sha1").alias("r_sha1"), F.col("page_id").alias("r_page_id"), "refers_to")
    return (rows.join(r, (F.col("sha1") == F.col("r_sha1")) & F.col("page_id").eqNullSafe(F.col("r_page_id")), "left")
            .select("page_id", "url", "html", "sha1", F.col("refers_to").isNotNull().alias("is_revisit"), "refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (see ``with_revisits``) to one archive per partition; returns ``path, records``."""

    def write(batches):
        stream = (row for batch in batches for row in batch.to_pylist())
        row = next(stream, None)
        if row is None:
            return
        filesystem, base = open_filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.zip"
        temporary = f"{base}/{name}.{uuid.uuid4().hex}.tmp"  # a repeated task replaces the archive as a whole
        lines, place = [], 0
        with filesystem.open_output_stream(temporary, compression=None) as out, \
                zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            with archive.open(RECORDS, "w", force_zip64=True) as member:
                while row is not None:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(row)) + packer.flush()
                    member.write(data)
                    lines.append(json.dumps({"id": row["page_id"], "offset": place, "length": len(data)}))
                    place += len(data)
                    row = next(stream, None)
            with archive.open(INDEX, "w", force_zip64=True) as member:
                member.write(("\n".join(lines) + "\n").encode())
        filesystem.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(lines)]})

    return stage(pages.mapInArrow(write, "path string, records long"))


class ZipDirectory:
    """Members of a ZIP file, read by ranges. ``read_at(size, offset)`` reads a range."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail = read_at(min(size, 22 + 65535), max(0, size - 22 - 65535))
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if (count, length, start) >= (0xFFFF, 0, 0) or 0xFFFFFFFF in (length, start):
            found = at - 20
            if found < 0 or tail[found:found + 4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            (where,) = struct.unpack_from("<Q", tail, found + 8)
            end = read_at(56, where)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        data, at = read_at(length, start), 0
        for _ in range(count):
            if data[at:at + 4] != ENTRY:
                raise ValueError("broken ZIP directory")
            (method,) = struct.unpack_from("<H", data, at + 10)
            packed, full, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46:at + 46 + n].decode()
            more = data[at + 46 + n:at + 46 + n + extra]
            full, packed, header = self._wide(more, full, packed, header)
            self.members[name] = (method, packed, header)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The values, those that overflow taken from the ZIP64 field, in its order."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4:at + 4 + size]
            at += 4 + size
        out, at = [], 0
        for v in values:
            if v == 0xFFFFFFFF:
                (v,) = struct.unpack_from("<Q", wide, at)
                at += 8
            out.append(v)
        return out

    def stored(self, name: str) -> tuple[int, int]:
        """(start, size) of a member's bytes in the file."""
        method, size, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        local = self.read_at(30, header)
        if local[:4] != LOCAL:
            raise ValueError("no local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + extra, size


def at_ranges(f):
    def read_at(size: int, offset: int) -> bytes:
        f.seek(offset)
        return f.read(size)
    return read_at


def read_archives(archives: DataFrame, bytes_per_range: int = 4 << 20) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every
    record in the archives (column ``path``)."""

    def index(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, name = open_filesystem(path)
                with filesystem.open_input_file(name) as f:
                    directory = ZipDirectory(at_ranges(f), f.size())
                    start, _ = directory.stored(RECORDS)
                    at, size = directory.stored(INDEX)
                    f.seek(at)
                    entries = [json.loads(line) for line in f.read(size).splitlines()]
                first = 0
                for i, e in enumerate(entries):
                    last = i + 1 == len(entries)
                    begin = entries[first]["offset"]
                    if last or entries[i + 1]["offset"] + entries[i + 1]["length"] - begin > bytes_per_range:
                        lengths = [x["length"] for x in entries[first:i + 1]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]), pa.array([start + begin]),
                             pa.array([lengths], pa.list_(pa.int64()))], ["path", "start", "lengths"])
                        first = i + 1

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, name = open_filesystem(row["path"])
                with filesystem.open_input_file(name) as f:
                    f.seek(row["start"])
                    data, at, out = f.read(sum(row["lengths"])), 0, []
                for n in row["lengths"]:
                    out.append(parse_record(zlib.decompress(data[at:at + n], 31)))
                    at += n
                columns = {k: [r[k] for r in out] for k in out[0]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.string() if k in ("payload_digest", "record_type") else pa.int64())
                     for k, v in columns.items()], list(columns))

    ranges = archives.select("path").repartition(
        shuffle_partitions(archives.sparkSession), "path").mapInArrow(index, "path string, start long, lengths array<long>")
    # a number of its own, as AQE would join these short rows that stand for long reads
    return ranges.repartition(shuffle_partitions(archives.sparkSession), "path", "start").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what reading them gives."""
    folder = shared_folder(pages.sparkSession, "warc-zip")
    return read_archives(write_archives(with_revisits(pages), folder))
