"""Deterministic sharded WARC writer (operator 10).

Records stand in the order of page id. Parts of about ``part_bytes`` are cut at
exact sums of payload bytes over blocks of ``BLOCK_IDS`` page ids, so they depend
on the pages alone, not on partitions or samples. Each part is written as gzip
members, one for each record, and rolls to a new file once the compressed size
passes ``roll_bytes``. Headers and digests are made anew from the payload, dates
are a parameter, and record ids follow from page id and digest, so equal tables
give files of equal names and bytes, whatever their partitioning. Of equal
payloads of ``least_bytes`` or more, the smallest page id is the response and the
others are revisits of it.

Files are written under temporary names; Spark commits the list of finished
ones, a second job renames those into place (which may be repeated), and the
manifest it commits is what readers go by. Files of lost attempts stay unnamed.

Defined results: null html is an empty payload; a null url gets a urn of its
page. Rows equal in page id and payload: one is the response, the repeats revisit
it. Null page ids sort first, in blocks by digest, so that many of them make many
parts, and count as largest in choosing the response. Very long payloads are records of their own size. An empty table gives an empty
manifest and no records. Only the id, url and html columns are read, so no other
column can clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import block_starts, discard, new_path, open_fs, written

ROLL_BYTES = 32 << 20
PART_BYTES = 64 << 20
BLOCK_IDS = 256
LEAST_BYTES = 100
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8a1d6d8e-4c1b-5c0e-9d0f-6b1f6d1f9a10")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info(name: str, date: str = DATE) -> bytes:
    body = f"software: ballast\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class _Rolling:
    """Writes members to files of a partition; a full file is closed and listed."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.fs, self.top = open_fs(folder)
        self.part, self.roll, self.seq = part, roll_bytes, 0
        self.file, self.listed = None, []

    def add(self, data: bytes) -> None:
        if self.file is None:
            self.final = f"part-{self.part:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.final}.{uuid.uuid4().hex}.tmp"
            self.file = self.fs.open_output_stream(f"{self.top}/{self.temp}")
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
            self._put(_member(_info(self.final)))
        self._put(_member(data))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.listed.append({"temp": self.temp, "file": self.final, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.file, self.seq = None, self.seq + 1


def write(pages: DataFrame, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, part_bytes: int = PART_BYTES) -> tuple[str, DataFrame]:
    """Write all pages; gives the folder and the committed manifest (file, records, bytes, sha256)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    fs, top = open_fs(folder)
    fs.create_dir(top)
    html = F.coalesce(F.col("html"), F.lit(""))
    # Rows without id may be many: they come first, in blocks by their digest.
    by_digest = F.lit(-(2**62)) + F.conv(F.substring("sha", 1, 4), 16, 10).cast("long")
    block = F.coalesce(F.floor(F.col("page_id") / BLOCK_IDS).cast("long"), by_digest)
    told = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha")).withColumn("block", block)
    narrow = written(told.select("page_id", "block", "sha", F.octet_length("html").cast("long").alias("n")), "warc-narrow")
    sums = block_starts(narrow.groupBy("block").agg(F.sum("n").alias("bytes")).withColumn("all", F.lit(0)), ["all"], "block", "bytes", "before")
    parts = written(sums.select("block", F.floor(F.col("before") / part_bytes).cast("int").alias("part")), "warc-parts")
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1

    long = narrow.filter(F.col("n") >= least_bytes)
    firsts = long.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND first IS NOT NULL").drop("rows")
    marks = long.join(firsts, "sha").filter("page_id IS NULL OR page_id <> first")
    marks = marks.select("page_id", "block", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "first")
    content = told.select("page_id", "block", F.lit(1).alias("kind"), "url", "html", "sha", F.lit(None).cast(pages.schema["page_id"].dataType).alias("first"))
    rows = content.unionByName(marks).join(parts, "block").drop("block").repartitionById(count, "part").sortWithinPartitions("part", "page_id", "kind", "sha", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part_now, listed = None, None, []
        now, revisits, said = object(), {}, set()
        for b in batches:
            for page_id, kind, url, text, sha, first, part in zip(*(c.to_pylist() for c in b.columns)):
                if part != part_now:
                    if out is not None:
                        out.close()
                        listed += out.listed
                    part_now, out = part, _Rolling(folder, part, roll_bytes)
                if page_id != now:
                    now, revisits, said = page_id, {}, set()
                if kind == 0:
                    revisits[sha] = first
                    continue
                payload = text.encode()
                repeat = len(payload) >= least_bytes and sha in said
                said.add(sha)
                refers = revisits.get(sha, page_id if repeat else None)
                out.add(record(page_id, url, payload, sha, refers, sha in revisits or repeat))
        if out is not None:
            out.close()
            listed += out.listed
        yield pa.RecordBatch.from_pylist(listed, schema=pa.schema([("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    finished = written(rows.mapInArrow(run, "temp string, file string, records long, bytes long, sha256 string"), "warc-finished")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, top = open_fs(folder)
        for b in batches:
            for temp, name in zip(b.column("temp").to_pylist(), b.column("file").to_pylist()):
                if fs.get_file_info(f"{top}/{temp}").type != FileType.NotFound:
                    fs.move(f"{top}/{temp}", f"{top}/{name}")
            yield b.select(["file", "records", "bytes", "sha256"])

    manifest = written(finished.mapInArrow(rename, "file string, records long, bytes long, sha256 string"), "warc-manifest")
    discard(narrow, parts, finished)
    return folder, manifest


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip stream; holds one record at a time."""
    z, data, raw = zlib.decompressobj(31), b"", b""
    while True:
        if not raw:
            raw = stream.read(1 << 16)
            if not raw:
                return
        data += z.decompress(raw)
        raw = z.unused_data if z.eof else b""
        if z.eof:
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield headers, rest[:size]
            z, data = zlib.decompressobj(31), b""


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Records back from the archives, digests checked."""
    n = max(1, manifest.count())  # files, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: a block digest is wrong")
                        size = int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        rows.append({"page_id": page and int(page), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": refers and int(refers)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("file").repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read(*write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id <> f.first AND d.payload_bytes >= {LEAST_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> f.first AND d.payload_bytes >= {LEAST_BYTES} THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
