"""Web archives: WARC records in ZIP packages, written and range-read by Spark tasks.

A package holds ``archive/data.warc.gz`` (a gzip member per record) and
``indexes/index.cdxj`` (a line per record), both stored uncompressed by ZIP, so a record
is found through the central directory and the index and read with one range request.
Executors reach the packages through ``pyarrow.fs``, by the URI of the shared folder.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulselake.llm.common import materialise, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 100
#: A package is closed and the next one begun beyond this many bytes.
PACKAGE_BYTES = 256 << 20
#: Records that lie together are read in ranges of about this many bytes.
RANGE_BYTES = 4 << 20
_DATE = "2024-01-01T00:00:00Z"


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def read_directory(file) -> list[Member]:
    """The central directory of a ZIP file, ZIP64 or not, from range reads alone."""
    total = file.size()
    tail_at = max(0, total - 65_557)
    tail = file.read_at(total - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        record = file.read_at(56, end64)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = file.read_at(size, offset), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, _, _, _, packed, size_, n_name, n_extra, n_comment = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values of those fields that are full, in this order
                p = k + 4
                for field in ("size", "packed", "header"):
                    if {"size": size_, "packed": packed, "header": header}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", extra, p)
                        p += 8
                        if field == "size":
                            size_ = value
                        elif field == "packed":
                            packed = value
                        else:
                            header = value
            k += 4 + length
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    header = file.read_at(30, member.header)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit (HTTP head only) if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, page id, reference, digest and length of the full payload, and the payload itself (None: a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"type": kind, "page_id": page(fields["WARC-Record-ID"]), "refers_to": page(fields.get("WARC-Refers-To")), "digest": digest, "bytes": length, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def write_packages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns (package, records).

    Of rows with equal payloads of at least ``LEAST_REVISIT`` bytes the smallest ``page_id``
    is the response and the others revisit it. Null html is an empty payload; a null
    ``page_id`` never takes part in revisits; rows that repeat the smallest ``page_id`` are
    responses as well. Packages are named by task attempt and the table of those that
    succeeded is materialised, so retried and speculative tasks leave no doubles behind.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    keys = materialise(rows.filter(F.octet_length("html") >= LEAST_REVISIT).filter("page_id is not null").select("page_id", "digest"))
    firsts = materialise(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last != refers_to").drop("last"))
    revisits = materialise(keys.join(firsts, "digest").filter("page_id != refers_to").distinct())
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        package = None

        def begin() -> dict:
            name = f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
            stream = files.open_output_stream(f"{root}/{name}")
            package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
            member = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
            return {"name": name, "stream": stream, "zip": package, "data": member, "at": 0, "lines": []}

        def finish(p: dict) -> None:
            p["data"].close()
            p["zip"].writestr(zipfile.ZipInfo(INDEX), "".join(sorted(p["lines"])))
            p["zip"].close()
            p["stream"].close()
            done.append((f"{folder}/{p['name']}", len(p["lines"])))

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or begin()
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                record = format_record(page_id, url, text.encode("utf-8", "replace"), digest, refers_to)
                packed = pack.compress(record) + pack.flush()
                package["data"].write(packed)
                entry = {"url": url, "digest": f"sha256:{digest}", "offset": package["at"], "length": len(packed), "filename": DATA}
                package["lines"].append(f"{page_id} {_DATE} {json.dumps(entry)}\n")
                package["at"] += len(packed)
                if package["at"] > PACKAGE_BYTES:
                    finish(package)
                    package = None
        if package:
            finish(package)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64()))], names=["package", "records"])

    return materialise(rows.mapInArrow(run, "package string, records long"))


def locate_records(packages: DataFrame) -> DataFrame:
    """(package, start, ends): ranges of adjacent records, from each package's directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, list[int]]] = []
            for uri in batch.column(0).to_pylist():
                files, path = pafs.FileSystem.from_uri(uri)
                with files.open_input_file(path) as file:
                    members = {m.name: m for m in read_directory(file)}
                    base = data_offset(file, members[DATA])
                    index = members[INDEX]
                    text = file.read_at(index.size, data_offset(file, index)).decode("utf-8")
                entries = [json.loads(line.split(" ", 2)[2]) for line in text.splitlines()]
                start, ends = None, []
                for offset, length in sorted((e["offset"], e["length"]) for e in entries):
                    if start is not None and (offset + length - start > RANGE_BYTES or offset != ends[-1]):
                        out.append((uri, base + start, [x + base for x in ends]))
                        start, ends = None, []
                    start = offset if start is None else start
                    ends.append(offset + length)
                if ends:
                    out.append((uri, base + start, [x + base for x in ends]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["package", "start", "ends"]
            )

    return packages.select("package").repartition("package").mapInArrow(run, "package string, start long, ends array<long>")


def read_records(ranges: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record, read with a range request per row of ``ranges``."""
    kinds = {"page_id": pa.int64(), "bytes": pa.int64(), "digest": pa.string(), "type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"url": pa.string(), "payload": pa.binary()} if payloads else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, ends in zip(*(c.to_pylist() for c in batch.columns)):
                files, path = pafs.FileSystem.from_uri(uri)
                with files.open_input_file(path) as file:
                    raw = file.read_at(ends[-1] - start, start)
                found, at = [], 0
                for end in ends:
                    found.append(parse_record(zlib.decompress(raw[at : end - start], 31)))
                    at = end - start
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], names=list(kinds))

    schema = "page_id long, bytes long, digest string, type string, refers_to long" + ", url string, payload binary" * payloads
    return ranges.repartition("package", "start").mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages, read them back, and return a row per record."""
    found = read_records(materialise(locate_records(write_packages(pages))))
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
