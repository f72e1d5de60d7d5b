"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damaged archives still hold.

Writing. Every row becomes one record. Of rows with equal payloads (SHA-1, length and a second hash agree) of at least
``min_bytes`` the one with the smallest id is a *response*; the others are *revisits* that refer to it and hold its digest
and HTTP headers only. Smaller payloads are all responses. Only digests are grouped, with partial sums before the shuffle.
Records are gzip members of their own, one after the other, or plain; Spark's text sink writes them, so any file system that
Spark knows will do. It ends each row with a separator: the CRLF CRLF that ends a plain record, or the last byte of a member.
That byte is zero for members below 16 MiB; behind a larger one stands an empty member, which ends so too.

Reading. An archive is one row of Spark's ``binaryFile`` source, so it must fit in a task (2 GB at most); the writer's
archives hold ``records_per_archive`` records. The reader goes from record to record and checks each: the member's checksum,
version line, header lines, length, record end, and SHA-1 digests where there are any. After a failed check it searches
for the next member or version line from which a record passes all checks, goes on there, and logs the bytes between as a
gap with the first failed check.

Null payloads are empty; a null url has no header; characters that can't stand in a header are percent-encoded. Rows with a
null id are records without an id: they refer to others, but none refers to them, so they are responses if no equal row has
an id. Rows with the same id and payload as a response are responses too. Other columns are not stored. An empty table
gives no archive, and no records are read from it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featureline.llm.frames import fields, record

READ = T.StructType(fields("archive string, offset long, length long, record_type string, record_id string, refers_to string, "
                           "target_uri string, payload_digest string, payload_bytes long, payload binary, problem string"))
#: Bytes that a task gathers before it hands over a batch.
GATHERED = 1 << 23
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_BAD = re.compile(r"[\x00-\x20\x7f]")
#: What ends a record.
_END = b"\r\n\r\n"


class Damaged(ValueError):
    """A check that failed."""


def digest_text(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(sha1(data).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as gzip that ends with a zero byte."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + member(b"")


def page_record(id: int | None, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """One record without what ends it: the payload in an HTTP response, or the mere headers of a revisit."""
    digest = digest_text(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers is None else "revisit"),
            f"WARC-Record-ID: <urn:row:{'' if id is None else id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:row:{refers}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_text(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block


def write_archives(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
                   records_per_archive: int = 5000, date: str = "2000-01-01T00:00:00Z", compress: bool = True, level: int = 6) -> None:
    """Writes one record per row below ``path``."""
    whole = pages.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"),
                         F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    same = ["sha", "size", "check"]
    digests = whole.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("check"))
    groups = digests.where(F.col("size") >= min_bytes).groupBy(same).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    rows = digests.join(groups.where("rows > 1").drop("rows"), same, "left") \
        .select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("first") < F.col("id")), F.col("first")).alias("refers"))
    schema = T.StructType(fields("record binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers"))):
                made = page_record(*(x.as_py() for x in row), date)
                made = member(made + _END, level)[:-1] if compress else made
                out.append(made)
                size += len(made)
                if size >= GATHERED:
                    yield record(schema, {"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield record(schema, {"record": pa.array(out, pa.binary())})

    rows.mapInArrow(run, schema).select(F.col("record").cast("string").alias("value")).write \
        .option("lineSep", "\0" if compress else _END.decode()).option("maxRecordsPerFile", records_per_archive).text(path)


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header lines from ``at`` on, with lower-case names, and where they end."""
    out: dict[str, str] = {}
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise Damaged("headers without end")
        line = data[at:end].rstrip(b"\r")
        at = end + 1
        if not line:
            return out, at
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        out.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode(errors="replace"))


def _matches(stated: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1 (base32 or hex) is that of the data; other digests are not looked at."""
    kind, _, value = (stated or "").partition(":")
    if kind.strip().lower() != "sha1":
        return True
    own = sha1(data).digest()
    return value.strip().upper() in (base64.b32encode(own).decode(), own.hex().upper())


def parsed(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where it ends; raises if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head, start = _headers(data, version.end())
    if not re.fullmatch(r"[0-9]+", size := head.get("content-length", "")):
        raise Damaged("no length")
    end = start + int(size)
    if end > len(data):
        raise Damaged("cut off")
    if data[end:end + 4] != _END:
        raise Damaged("no record end")
    block = data[start:end]
    if not _matches(head.get("warc-block-digest"), block):
        raise Damaged("block digest")
    kind, payload, http = head.get("warc-type"), block, {}
    if head.get("content-type", "").lower().startswith("application/http"):
        status = block.find(b"\n")
        http, body = _headers(block, status + 1) if status >= 0 else ({}, 0)
        payload = block[body:]
    if kind == "revisit":
        stated = head.get("warc-payload-digest", "").partition(":")[2] or None
        size = http.get("content-length", "")
        found = {"payload_digest": stated, "payload_bytes": int(size) if size.isdecimal() else None, "payload": None}
    else:
        if not _matches(head.get("warc-payload-digest"), payload):
            raise Damaged("payload digest")
        found = {"payload_digest": digest_text(payload), "payload_bytes": len(payload), "payload": payload}
    bare = lambda name: head[name].strip("<>") if name in head else None
    return found | {"record_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"),
                    "target_uri": head.get("warc-target-uri")}, end + 4


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the member at ``at``, and where it ends."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(data):
                raise Damaged("member cut off")
            out.append(unpack.decompress(data[pos:pos + 65536]))
            pos += 65536
    except zlib.error:
        raise Damaged("member check") from None
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data)


def _unit(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the member at ``at``, or the plain record there, and where they end."""
    if data[at:at + 3] != _MEMBER:
        found, end = parsed(data, at)
        return [found], end
    content, end = _inflated(data, at)
    found, pos = [], 0
    while pos < len(content):
        one, pos = parsed(content, pos)
        found.append(one)
    return found, end


def salvage(data: bytes) -> Iterator[dict]:
    """All records that pass their checks, and the gaps between them (``problem`` is set), in the order of the archive."""
    at, gap, problem = 0, None, None
    next_member = next_version = -1
    while at < len(data):
        try:
            found, end = _unit(data, at)
        except Damaged as failed:
            if gap is None:
                gap, problem = at, str(failed)
            # Each kind of beginning is searched for again only when its last find lies behind.
            if next_member <= at:
                next_member = data.find(_MEMBER, at + 1)
                next_member = len(data) if next_member < 0 else next_member
            if next_version <= at:
                m = _VERSION.search(data, at + 1)
                next_version = m.start() if m else len(data)
            at = min(next_member, next_version)
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "problem": problem}
            gap = None
        for one in found:
            yield one | {"offset": at, "length": end - at}
        at = end
    if gap is not None:
        yield {"offset": gap, "length": len(data) - gap, "problem": problem}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``, and gaps as rows with a ``problem``; offsets are those in the archive's file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                name, out, size = archive.as_py(), [], 0
                for row in salvage(content.as_py()):
                    out.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size >= GATHERED:
                        yield _batch(name, out)
                        out, size = [], 0
                yield _batch(name, out)

    return files.mapInArrow(run, READ)


def _batch(archive: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    return record(READ, {f.name: pa.array([archive if f.name == "archive" else r.get(f.name) for r in rows], kinds[f.dataType])
                         for f in READ})


def records(read: DataFrame) -> DataFrame:
    """What :func:`read_archives` could read."""
    return read.where("problem IS NULL").drop("problem")


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: byte ranges that no record could be read from, and the first check that failed there."""
    return read.where("problem IS NOT NULL").select("archive", "offset", "length", "problem")


def row_id(urn: str):
    """The id of a row out of its record's id."""
    return F.regexp_extract(urn, r"^urn:row:(-?\d+)$", 1).try_cast("long")
