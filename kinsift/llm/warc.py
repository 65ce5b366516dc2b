"""WARC archives: a deduplicating writer, and a reader that salvages what damage leaves.

Writing. Of records with equal payloads of at least `DEDUP_BYTES`, the one with the largest id is a
response and the others are revisits that refer to it. Every record is a gzip member of its own, as
archives of the web are. The files are written by Spark's text writer, so they can lie in any store
that Spark writes to and a lost executor's files are never seen half written: a row is a member without
its last byte, and the line separator is that byte. A gzip member ends in the upper byte of its length,
which is 0 below 16 MiB; a larger member is followed by an empty one, which ends in 0 too. Files are rolled
by bytes: a task gathers members up to `FILE_BYTES`, or one larger one, into a row, and a row is a file.

Reading. A file is walked from its start. A record counts if its member's checksum, its header, its
content length, the two line ends after it and its payload digest are right. After a failed check the
reader goes to the next place behind the failure where a gzip member or a version line begins, tries
there, and so on; the bytes skipped are logged as one quarantined gap. Uncompressed archives and files
that mix both are read the same way. A file is one row of Spark's `binaryFile` reader, and so at most
2 GB.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.llm.common import pieces, read
from kinsift.storage import materialize, new_path

DEDUP_BYTES = 1000
#: Bytes of a file, unless a single member has more.
FILE_BYTES = 16 << 20
#: Bytes that one member may expand to, unless its record declares more; bytes that no value can exceed.
MOST, LIMIT = 1 << 28, (1 << 31) - 1
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A record's name, from which page_id() gets the id back; a null id has a name of its own."""
    x = "ffff00000000000000" if page_id is None else f"0000{page_id & (1 << 64) - 1:016x}"[:20]
    x = x.ljust(20, "0")
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-8{x[12:15]}-8{x[15:18]}-{x[18:20]}0000000000>"


def page_id(name: str) -> int | None:
    """The id in a record's name; None for a null id's name and for other names."""
    m = re.fullmatch(r"<urn:uuid:0000([0-9a-f]{4})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f]{3})-([0-9a-f]{2})0{10}>", name.strip())
    if not m:
        return None
    value = int("".join(m.groups()), 16)
    return value - (1 << 64) if value >> 63 else value


def build(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit has its payload's digest and length, not the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record's gzip member, and an empty one where it would not end in a zero byte."""
    out = b""
    for part in (record, b"")[: 1 + (len(record) >> 24 & 255 > 0)]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(part) + z.flush()
    return out


def referred(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """pages with `refers_to`: the largest id of an equal payload that is long enough, where it isn't this row's own."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    keyed = pages.withColumn("_digest", F.sha1(payload.cast("binary"))).withColumn("_bytes", F.octet_length(payload))
    groups = keyed.where(F.col("_bytes") >= DEDUP_BYTES).groupBy("_digest", "_bytes").agg(F.max(id_col).alias("_last"), F.count("*").alias("_n"))
    groups = materialize(groups.where("_n > 1").select(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_last"), "payloads")
    joined = keyed.join(groups, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
    return joined.withColumn("refers_to", F.when(F.col(id_col) < F.col("_last"), F.col("_last"))).select(*pages.columns, "refers_to")


def gathered(members: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Members one after another, in pieces of at most `most` bytes or of one member."""
    held, size = [], 0
    for one in members:
        if held and size + len(one) > most:
            yield b"".join(held)
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield b"".join(held)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write a record for every row of pages to gzip archives in the folder path, of at most file_bytes or one record each.

    A null payload is an empty one, a null URL has no header line. A row with a null id is a response and
    is nobody's original. Equal rows are both written, and rows that share the largest id of a payload
    are all responses. An empty table makes a folder without records. Other columns aren't written.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in pieces(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())
            for page, url, payload, to in rows:
                yield member(build(page, url, payload or b"", to, date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in gathered(made(batches), file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([file[:-1]], pa.binary())], ["value"])

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    files = referred(narrow, "id", "payload").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class Found(NamedTuple):
    kind: str  # record or gap
    offset: int
    length: int
    reason: str | None = None
    record_type: str | None = None
    page: int | None = None
    refers_to: int | None = None
    url: str | None = None
    digest: str | None = None
    payload: bytes | None = None


def parse(data: bytes, at: int, offset: int) -> tuple[Found | str, int]:
    """The record that begins at `at`, or what is wrong with it, and where it ends."""
    if not data.startswith(VERSION, at):
        return "no version line", at
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "header without an end", at
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return "header line without a colon", at
        fields.setdefault(name.strip().lower(), value.strip())
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        return "no content length", at
    start, stop = end + 4, end + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no two line ends after the block", at
    block, kind = data[start:stop], fields.get("warc-type", "")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if kind != "revisit" and algorithm == "sha1" and re.fullmatch("[0-9a-f]{40}", digest) and hashlib.sha1(payload).hexdigest() != digest:
        return "payload digest differs", at
    own = page_id(fields.get("warc-record-id", ""))
    to = page_id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return Found("record", offset, 0, None, kind, own, to, fields.get("warc-target-uri"), digest or None, None if kind == "revisit" else payload), stop + 4


def declared(parts: list[bytes]) -> int:
    """The length of the record that begins the content in parts, by its own header; 0 if there is none."""
    content = b"".join(parts)
    end = content.find(b"\r\n\r\n")
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n", content[: end + 2], re.I) if content.startswith(VERSION) and end >= 0 else None
    return end + 8 + int(m[1]) if m else 0


def expand(data: bytes, at: int) -> tuple[bytes | str, int]:
    """The content of the gzip member that begins at `at`, or what is wrong with it, and where it ends."""
    z, parts, held, to, most = zlib.decompressobj(31), [], 0, at, MOST
    while not z.eof:
        if to >= len(data):
            return "gzip member without an end", at
        try:
            parts.append(z.decompress(data[to : to + (1 << 15)]))
        except zlib.error as error:
            return f"gzip member: {error}", at
        to += 1 << 15
        held += len(parts[-1])
        if held > most == MOST:
            most = max(MOST, min(declared(parts), LIMIT))
        if held > most:
            return "gzip member too large", at
    return b"".join(parts), min(to, len(data)) - len(z.unused_data)


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def salvage(data: bytes) -> Iterator[Found]:
    """The records of an archive's bytes and the gaps between them, in order."""
    at, gap, reason = 0, -1, None
    while at < len(data):
        found: list[Found] = []
        end, wrong = at, "neither a member nor a version line"
        if data.startswith(b"\x1f\x8b\x08", at):
            content, end = expand(data, at)
            wrong = content if isinstance(content, str) else None
            inner = 0
            while wrong is None and inner < len(content):
                record, inner = parse(content, inner, at)
                if isinstance(record, str):
                    wrong, end = record, at
                else:
                    found.append(record._replace(length=end - at))
        elif data.startswith(VERSION, at):
            record, end = parse(data, at, at)
            wrong = record if isinstance(record, str) else None
            if wrong is None:
                found = [record._replace(length=end - at)]
        if wrong is None:
            if gap >= 0:
                yield Found("gap", gap, at - gap, reason)
                gap = -1
            yield from found
            at = end
            continue
        if gap < 0:
            gap, reason = at, wrong
        yield from found  # those of a member before its damaged record
        m = _NEXT.search(data, at + 1)
        at = m.start() if m else len(data)
    if gap >= 0:
        yield Found("gap", gap, len(data) - gap, reason)


SCHEMA = "path string, kind string, offset long, length long, reason string, record_type string, page_id long, refers_to long, url string, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (kind `record`) and quarantined byte gaps (kind `gap`) of the archives in the folder path.

    offset and length are those of the member, or of the record where it isn't compressed. A revisit has
    no payload of its own; resolve() finds it. Records of other kinds than response and revisit come too.
    A folder without archives gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for found in salvage(data.as_py()):
                    rows.append((name.as_py(), *found))
                    held += len(found.payload or b"")
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with payload_bytes: a response's own length; a revisit's is that of the response it refers to, null if that is lost.

    Gaps are left out. Of responses with one id and digest, which then have one length, it doesn't matter
    which is referred to; repeated records stay. Records with a null page_id are referred to by none. No
    records give an empty result.
    """
    own = records.where("kind = 'record'").withColumn("own", F.octet_length("payload").cast("long")).drop("payload")
    own = materialize(own, "records")  # so that the archives are parsed once, not for each side of the join
    originals = own.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("own").alias("theirs"))
    originals = originals.select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest"), "theirs")
    joined = own.join(originals, (F.col("refers_to") == F.col("_to")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("theirs")).otherwise(F.col("own"))).drop("_to", "_digest", "theirs", "own")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    return resolve(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < original THEN original END AS refers_to
FROM q
"""
