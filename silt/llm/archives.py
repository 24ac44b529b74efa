"""Legacy archive converter: ARC files of either version become WARC files, which are read back.

An ARC file opens with a version block that names its header fields (five in version 1, ten in version 2); each record is one header line, as many bytes as
the line declares, and a line end.  Converting synthesises what WARC needs and ARC lacks: a record identifier (a UUID from address, date, page and digest),
an ISO timestamp from the 14 digits, a type from the address's scheme, and a payload digest.  Records with equal payloads of at least ``LEAST_SHARED`` bytes
become revisits of the one with the smallest page id.

Archives are bounded (``ARCHIVE_BYTES``; one larger record stands alone), written and read through Spark, so any file system will do: records are lines of the text writer with the
format's own separator, bytes unchanged, gzipped.  Only digests and ids are compared across records; what is decided travels to each archive by its name.

Defined cases: a null payload is empty, a null url becomes urn:page:<id>; rows that share the smallest page id are all responses; a null page id is never the
smallest, and is a response where no other is; repeated rows give a row each; an empty table gives no archives and an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm.common import map_arrow, new_folder, saved

ARCHIVE_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
LEAST_SHARED = 100
DATE = "20240101000000"
# The header fields of either version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SEPARATOR = b"\r\n\r\n"


def version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 silt\n{FIELDS[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(head).encode() + b"\n" + body


def arc_record(url: str, content: bytes, version: int, offset: int, name: str, date: str = DATE, kind: str = "text/html") -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    extra = ["200", hashlib.md5(content).hexdigest(), "-", str(offset), name] if version == 2 else []
    return " ".join([url, "127.0.0.1", date, kind, *extra, str(len(content))]).encode("utf-8", "surrogatepass") + b"\n" + content


@dataclass
class ArcRecord:
    url: str
    date: str
    kind: str
    content: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its version block."""
    end = data.index(b"\n")
    if not data.startswith(b"filedesc://"):
        raise ValueError("an ARC file starts with a filedesc record")
    size = int(data[:end].rsplit(b" ", 1)[1])
    block = data[end + 1 : end + 1 + size].split(b"\n")
    version = int(block[0].split(b" ", 1)[0])
    names = block[1].decode().split(" ")
    if names != FIELDS.get(version, "").split(" "):
        raise ValueError(f"unknown ARC version {version}")
    at = end + 1 + size + 1
    while at < len(data):
        end = data.index(b"\n", at)
        head = dict(zip(names, data[at:end].decode("utf-8", "surrogatepass").split(" "), strict=True))
        size = int(head["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError("a record is shorter than its header declares")
        yield ArcRecord(head["URL"], head["Archive-date"], head["Content-type"], data[end + 1 : end + 1 + size])
        at = end + 1 + size + 1


@dataclass
class Converted:
    """What a WARC record has and an ARC record lacks."""

    record_id: str
    date: str
    kind: str
    page: int | None
    http: bytes
    payload: bytes
    digest: str


def converted(r: ArcRecord) -> Converted:
    http, cut, payload = r.content.partition(_SEPARATOR) if r.content.startswith(b"HTTP/") else (b"", b"", r.content)
    digest = hashlib.sha256(payload).hexdigest()
    m = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
    page = int(m[1]) if m else None
    date = f"{r.date[:4]}-{r.date[4:6]}-{r.date[6:8]}T{r.date[8:10]}:{r.date[10:12]}:{r.date[12:14]}Z"
    kind = "response" if http else "resource"
    return Converted(f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.url} {r.date} {page} {digest}')}>", date, kind, page, http + cut, payload, digest)


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _SEPARATOR + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(_SEPARATOR, at)
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != _SEPARATOR:
            raise ValueError("a record's length isn't what its header declares")
        yield head, block
        at = end + 8 + size


def _written(rows: DataFrame, path: str, separator: str) -> None:
    """Rows (archive, seq, record) as one gzipped file for each archive."""
    lines = rows.sortWithinPartitions("archive", "seq").select("archive", F.col("record").cast("string").alias("record"))
    lines.write.partitionBy("archive").option("lineSep", separator).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files below a folder."""
    kind = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return kind.select(F.regexp_extract("path", "archive=([^/]+)", 1).alias("name"), "content")


def _records(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES; a larger record stands alone."""

    def batch(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        names, seqs, records = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(seqs, pa.int64()), pa.array(records, pa.binary())], names=["archive", "seq", "record"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """``pages`` as ARC files, versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            part, n, size, seq, version, name = TaskContext.get().partitionId(), -1, ARCHIVE_BYTES, 0, 1, ""
            for b in batches:
                for k, u, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                    payload = (h or "").encode("utf-8", "surrogatepass")
                    if size + len(payload) > ARCHIVE_BYTES or n < 0:
                        n += 1
                        version, name, seq = 1 + (part + n) % 2, f"{part:06d}-{n:06d}", 0
                        first = version_block(name, version)
                        size = len(first)
                        yield name, seq, first
                    page = "" if k is None else f"X-Page-Id: {k}\r\n"
                    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    record = arc_record(u if u else f"urn:page:{k}", content, version, size, name)
                    size, seq = size + len(record) + 1, seq + 1
                    yield name, seq, record

        yield from _records(rows())

    _written(map_arrow(pages.select(key, url, html), run, "archive string, seq long, record binary"), path, "\n")


def _index(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                got = [(name, i, c.page, c.digest, len(c.payload), c.record_id) for i, c in enumerate(map(converted, read_arc(zlib.decompress(data.as_buffer(), 31))))]
                cols = list(zip(*got)) if got else [[]] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["name", "seq", "page", "digest", "size", "id"])

    return map_arrow(files, run, "name string, seq long, page long, digest string, size long, id string")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """The ARC files below ``arc`` as WARC files below ``warc``."""
    index = saved(_index(_files(spark, arc)), "arc-index")
    shared = index.where(F.col("size") >= LEAST_SHARED)
    first = shared.groupBy("digest").agg(F.min(F.when(F.col("page").isNotNull(), F.struct("page", "id"))).alias("f"), F.count("*").alias("n")).where("n > 1 and f is not null").select("digest", "f")
    again = shared.join(first, "digest").where("not (page <=> f.page)").groupBy("name").agg(F.collect_list(F.struct("seq", F.col("f.id").alias("id"))).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, data, again in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    refers = {x["seq"]: x["id"] for x in again or ()}
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", f"{DATE[:4]}-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
                    yield name, 0, warc_record(info, b"software: silt\r\nformat: WARC File Format 1.1\r\n")
                    for i, r in enumerate(read_arc(zlib.decompress(data.as_buffer(), 31))):
                        c = converted(r)
                        head = [("WARC-Type", "revisit" if i in refers else c.kind), ("WARC-Record-ID", c.record_id), ("WARC-Date", c.date), ("WARC-Target-URI", r.url), ("WARC-Payload-Digest", f"sha256:{c.digest}")]
                        if i in refers:
                            head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers[i])]
                        head.append(("Content-Type", "application/http;msgtype=response" if c.http else r.kind))
                        yield name, i + 1, warc_record(head, c.http if i in refers else c.http + c.payload)

        yield from _records(rows())

    files = _files(spark, arc).join(again, "name", "left").select("name", "content", "again")
    _written(map_arrow(files, run, "archive string, seq long, record binary"), warc, _SEPARATOR.decode())


def read_back(spark: SparkSession, warc: str) -> DataFrame:
    """(page, id, type, size, digest, refers) of the records in the WARC files; payload digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1):
                got = []
                for head, block in read_warc(zlib.decompress(data.as_buffer(), 31)):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(_SEPARATOR) if block.startswith(b"HTTP/") else (b"", b"", block)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = head["WARC-Type"] != "revisit"
                    if whole and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
                    m = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
                    got.append((int(m[1]) if m else None, head["WARC-Record-ID"], head["WARC-Type"], len(payload) if whole else None, digest, head.get("WARC-Refers-To")))
                cols = list(zip(*got)) if got else [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page", "id", "type", "size", "digest", "refers"])

    return map_arrow(_files(spark, warc), run, "page long, id string, type string, size long, digest string, refers string")


def report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) after pages -> ARC -> WARC -> records."""
    spark = pages.sparkSession
    base = new_folder(spark, "archives")
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc")
    rows = saved(read_back(spark, f"{base}/warc"), "warc-records")
    whole = rows.where("type <> 'revisit'").select(F.col("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    first = rows.where("type <> 'revisit'").groupBy("id").agg(F.max("size").alias("payload_bytes"), F.max("page").alias("refers_to")).withColumnRenamed("id", "refers")
    again = rows.where("type = 'revisit'").select("page", "digest", "refers").join(first, "refers")
    return whole.unionByName(again.select(F.col("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM q
"""
