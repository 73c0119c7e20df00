"""WARC archives with a shared Zstandard dictionary.

``write_archives`` makes a dictionary from a bounded sample of the records, and
writes archives to a folder: each begins with a skippable frame that holds the
dictionary, then come the records, each compressed as a frame of its own, so any
can be read at its offset. Payloads are written once: of records with equal
payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest page_id is a
response, the others are revisits that refer to it. ``read_archives`` reads a
folder's archives back, checks the digest of every payload, and gives records.

Archives are bounded in size and written under a temporary name, which becomes
their own when they are whole. Their names follow from the partition, whose rows
are in order of page_id; so a task that runs again writes the same files again.
The folder may be on any file system that Arrow opens by its URI (local, hdfs, s3,
gs, abfss; s3a is s3 there); archives are read by Spark's own reader.

Only groups of equal payloads are looked up: they are broadcast if they are few
(``BROADCAST_GROUPS``), else joined by (digest, salt), so that a payload shared by
a third of all pages is spread.

Defined results: a null html is an empty payload; a null page_id is written as a
response and read back as null; rows of the smallest page_id are all responses;
a null or odd url is written as a urn or percent-encoded; an empty table gives no
archive. With too few records to make a dictionary, archives have none.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, run_dir, staged, written

REVISIT_BYTES = 100
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16_000_000
#: The dictionary's sample: records, and bytes of each; its own size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 64 * 1024
BROADCAST_GROUPS = 100_000
SALTS = 32
LEVEL = 3
#: Fixed values of the format: a skippable frame that holds a dictionary, the
#: frame magic, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records --------------------------------------------------------------
def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}/{digest}'.encode()).hexdigest()[:32])}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of a record. The payload
    of a response is measured; a digest that doesn't fit raises."""
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    page = int(head["Page-ID"]) if "Page-ID" in head else None
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "revisit":
        return page, int(head["Payload-Length"]), digest, kind, int(head["Refers-To-Page"])
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload's digest doesn't fit")
    return page, len(payload), digest, kind, None


# --- frames ---------------------------------------------------------------
def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, skippable) of each frame, from the frames' own headers."""
    at = 0
    while at < len(data):
        start, magic = at, struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            yield start, at, True
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        kind = data[at + 4]
        single = kind >> 5 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
        last = False
        while not last:
            block = int.from_bytes(data[at : at + 3], "little")
            last = block & 1
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 * (kind >> 2 & 1)
        yield start, at, False


def records(data: bytes) -> Iterator[bytes]:
    """An archive's records, decompressed one by one."""
    unpack = zstandard.ZstdDecompressor()
    for start, end, skippable in frames(data):
        if skippable:
            if struct.unpack_from("<I", data, start)[0] == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[start + 8 : end]))
        else:
            yield unpack.decompress(data[start:end])


def arrow_uri(folder: str) -> str:
    """The URI by which Arrow knows a folder that Hadoop names by ``folder``."""
    return re.sub(r"^s3[an]:", "s3:", folder)


# --- writing --------------------------------------------------------------
def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A trained dictionary; None if there is too little to train on."""
    samples = [s for s in samples if len(s) >= 16]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return None


def _with_revisits(pages: DataFrame, broadcast_groups: int) -> DataFrame:
    """Pages with digest, size and refers_to; revisits lose their payload."""
    payload = F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    large = rows.filter((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(groups.select(F.col("digest").alias("__digest"), "first"))
    if groups.count() <= broadcast_groups:
        met = rows.join(F.broadcast(groups), F.col("digest") == F.col("__digest"), "left")
    else:
        salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        met = rows.join(salted, (F.col("digest") == F.col("__digest")) & (F.col("salt") == F.col("__salt")), "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    met = met.withColumn("refers_to", refers)
    return met.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write pages (page_id, url, html) as archives in ``folder``; returns the
    index (archive, start, length, page_id, record_type), a written table."""
    rows = _with_revisits(pages, broadcast_groups)
    # The sample is chosen by narrow rows; what each task would offer of texts
    # would all go to the driver.
    hashed = pages.select(column(pages, "html", "string").alias("html"), F.xxhash64(column(pages, "page_id", "long"), column(pages, "url", "string")).alias("h")).filter("html IS NOT NULL")
    chosen = staged(hashed.select("h").distinct().orderBy("h").limit(SAMPLE_RECORDS))
    sample = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.substring("html", 1, SAMPLE_BYTES)).alias("html")).orderBy("h").collect()
    texts = [r.html.encode() for r in sample]
    heads = [record(i, None, t, len(t), hashlib.sha256(t).hexdigest(), None, date) for i, t in enumerate(texts)]
    dictionary = pages.sparkSession.sparkContext.broadcast(make_dictionary(heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(arrow_uri(folder))
        task = TaskContext.get()
        lead = dictionary_frame(dictionary.value) if dictionary.value else b""
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None, write_content_size=True)
        number, out, at, index = 0, None, 0, []
        name = part = ""

        def close() -> pa.RecordBatch:
            nonlocal out, index
            out.close()
            system.move(part, f"{base}/{name}")
            rows = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(index), pa.string()), pa.array([x[0] for x in index], pa.int64()), pa.array([x[1] for x in index], pa.int64()), pa.array([x[2] for x in index], pa.int64()), pa.array([x[3] for x in index], pa.string())],
                ["archive", "start", "length", "page_id", "record_type"],
            )
            out, index = None, []
            return rows

        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{number:05d}.warc.zst"
                    part = f"{base}/.{name}.{task.taskAttemptId()}"
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(part)
                    out.write(lead)
                    number, at = number + 1, len(lead)
                frame = pack.compress(record(page_id, url, payload, size, digest, refers_to, date))
                out.write(frame)
                index.append((at, len(frame), page_id, "response" if refers_to is None else "revisit"))
                at += len(frame)
                if at >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    ordered = rows.sortWithinPartitions("page_id", "digest")
    return written(ordered.mapInArrow(run, "archive string, start long, length long, page_id long, record_type string"), "warc-index")


# --- reading --------------------------------------------------------------
def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    record of a folder's archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [parse(r) for r in records(batch.column(0)[i].as_py())]
                page, size, digest, kind, refers = zip(*found, strict=True) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    folder = run_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder)


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""
