"""WARC records in ZIP packages: written per task, read by byte ranges through the ZIP directory.

A package holds two stored members: ``archive/data.warc.gz``, each record its own gzip
member, and ``indexes/index.cdxj``, one JSON line per record with its place.  Reading
parses the end record, the ZIP64 end record and the central directory, and then reads
ranges of the stored members; nothing is unpacked to disk.  Files are opened with pyarrow's
file systems, so the folder must be one that all executors reach (a shared mount, HDFS, an object store).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.session import shared_path
from .shared import meet, put

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records reach this size; a task reads about so many bytes at once.
PACKAGE_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.fullmatch(r"file:/+(.*)", path)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and size but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP + (payload if refers is None else b"")
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page is not None:
        head.append(("WARC-Page-ID", page))
    if refers is not None:
        head += [("WARC-Refers-To-Page-ID", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; a record with a payload must agree with its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError("payload and digest differ")
    return fields, payload


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row as a record; returns (path, records, bytes) of the packages.

    Of rows with equal payloads those with the smallest id are responses, others revisit it;
    rows without id are always responses; null html is an empty payload.  Packages have
    unique names, and only those of tasks that succeeded are listed, so repeated task attempts do no harm.
    """
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"),
                        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    digests = rows.where("page IS NOT NULL").select("page", "sha")
    first = put(digests.groupBy("sha").agg(F.min("page").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    revisits = meet(digests, first, "sha", "n", first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).where("page > refers").select("page", "sha", "refers").distinct()
    joined = rows.join(revisits, ["page", "sha"], "left").select("page", "url", "payload", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        package = None
        for batch in batches:
            for j in range(len(batch)):
                page, url_, payload, refers = (batch.column(c)[j].as_py() for c in range(4))
                if package is None:
                    package = _Package(system, f"{base}/{uuid.uuid4().hex}.wacz")
                package.add(page, record(page, url_, payload, refers))
                if package.at >= PACKAGE_BYTES:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    return put(joined.mapInArrow(run, "path string, records long, bytes long"), "packages")


class _Package:
    """A ZIP package while it is written."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.path, self.at, self.index = path, 0, []
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, page: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"page": page, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> pa.RecordBatch:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index) + "\n")
        self.zip.close()
        self.stream.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([len(self.index)], pa.int64()), pa.array([self.at], pa.int64())],
                                          names=["path", "records", "bytes"])


def members(source) -> dict[str, tuple[int, int]]:
    """(first byte, size) of each stored member, from the central directory of an open file."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = _range(source, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if tail[max(0, end - 20):end].startswith(b"PK\x06\x07"):
        where = struct.unpack("<Q", tail[end - 12:end - 4])[0]
        record64 = _range(source, where, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record64[32:56])
    directory, out, at = _range(source, start, length), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[at + 10:at + 12])[0]
        packed, full, n, m, k = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        local = struct.unpack("<I", directory[at + 42:at + 46])[0]
        name = directory[at + 46:at + 46 + n].decode("utf-8")
        extra, x = directory[at + 46 + n:at + 46 + n + m], 0
        while x + 4 <= len(extra):
            tag, size_ = struct.unpack("<HH", extra[x:x + 4])
            if tag == 1:
                values = list(struct.unpack(f"<{size_ // 8}Q", extra[x + 4:x + 4 + size_ // 8 * 8]))
                # Only fields that overflow are present, in this order.
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            x += 4 + size_
        if method == 0:
            a, b = struct.unpack("<HH", _range(source, local, 30)[26:30])
            out[name] = (local + 30 + a + b, packed)
        at += 46 + n + m + k
    return out


def _range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, lengths): runs of neighbouring records, from the index member of each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    found = members(source)
                    base, at, out, held = found[ARCHIVE][0], 0, [], []
                    for line in _range(source, *found[INDEX]).splitlines():
                        entry = json.loads(line)
                        if held and at + sum(held) != entry["offset"] or sum(held) >= range_bytes:
                            out.append((path, base + at, held))
                            held = []
                        at = at if held else entry["offset"]
                        held.append(entry["length"])
                    out += [(path, base + at, held)] if held else []
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=["path", "at", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, at long, lengths array<int>")


def read(spark: SparkSession, packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record; a revisit's payload is null."""
    jobs = ranges(packages, range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, lengths in zip(*(batch.column(j).to_pylist() for j in range(3))):
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    raw = _range(source, at, sum(lengths))
                rows, x = [], 0
                for n in lengths:
                    fields, payload = parse(zlib.decompress(raw[x:x + n], 31))
                    x += n
                    number = lambda k: int(fields[k]) if k in fields else None
                    rows.append((number("WARC-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Payload-Length"),
                                 fields["WARC-Payload-Digest"][5:], number("WARC-Refers-To-Page-ID"), payload if fields["WARC-Type"] == "response" else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=_NAMES)

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return jobs.repartition(spread).mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


_NAMES = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` below the shared folder and read them back, without the payloads."""
    packages = write(pages, shared_path(pages.sparkSession, "warc"))
    return read(pages.sparkSession, packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
