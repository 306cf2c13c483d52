"""WARC archives of pages, and the chunked record table that is read back from them.

Payloads stream in both directions: a record is compressed and written chunk by chunk, and read as rows of
record id and chunk number, each with the SHA-1 and the length of the payload so far, so that no record is ever
whole in memory beside the cell that holds it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.llm.common import shared_dir, small, store

CHUNK = 256 * 1024
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
SMALL_DIGESTS = 500_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "record_id long, url string, record_type string, refers_to long, chunk_no long, is_last boolean, "
    "data binary, payload_bytes long, payload_digest string, declared_digest string"
)


def file_system(uri: str):
    """The Arrow file system and path of a URI that executors reach (file, hdfs, s3, gs)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def record(key: int | None, url: str | None, payload: str | None, digest: str, length: int, refers_to: int | None) -> Iterator[bytes]:
    """The record's bytes, piece by piece. A null key is written as null; a null url has no header."""
    http = b"" if refers_to is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if key is None else key}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~', errors='surrogatepass')}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += [f"Content-Length: {len(http) + (length if refers_to is None else 0)}", "", ""]
    yield "\r\n".join(lines).encode() + http
    if refers_to is None and payload:
        for at in range(0, len(payload), CHUNK // 4):
            yield payload[at : at + CHUNK // 4].encode("utf-8", "surrogatepass")
    yield b"\r\n\r\n"


def decided(pages: DataFrame, text: str, key: str, url: str) -> DataFrame:
    """(key, url, payload, digest, length, refers_to): of equal payloads of REVISIT_BYTES or more, the largest key holds the response."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("length") >= REVISIT_BYTES).groupBy("digest", "length").agg(F.max("key").alias("holder"), F.count(F.lit(1)).alias("n"))
    repeated, _ = store(large.where("n > 1 AND holder IS NOT NULL").drop("n"), "repeated")
    rows = rows.join(small(repeated, SMALL_DIGESTS), ["digest", "length"], "left")
    return rows.select("key", "url", "payload", "digest", "length", F.when(~F.col("key").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url", directory: str | None = None, level: int = 1) -> DataFrame:
    """Write a gzip-compressed WARC file for each partition; returns the stored manifest (file, records).

    A file gets its name only when it is whole, so a task that runs again replaces it with the same bytes.
    """
    directory = directory or f"{shared_dir(pages.sparkSession)}/tracejobs/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        fs, path = file_system(directory)
        fs.create_dir(path, recursive=True)
        name, records = f"part-{at.partitionId():06d}.warc.gz", 0
        trial = f"{path}/_{name}.{at.taskAttemptId()}"
        with fs.open_output_stream(trial) as out:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    member = zlib.compressobj(level, wbits=31)
                    for piece in record(*row):
                        out.write(member.compress(piece))
                    out.write(member.flush())
                    records += 1
        fs.move(trial, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [f"{directory}/{name}"], "records": [records]})

    return store(decided(pages, text, key, url).mapInArrow(write, "file string, records long"), "manifest")[0]


def parse(stream) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(headers, chunk number, payload bytes, last) of a file of gzip members, each a record."""
    raw, member = b"", None
    while True:
        member, head = zlib.decompressobj(wbits=31), b""
        headers, left, number, http = None, 0, 0, b""
        started = False
        while not member.eof:
            raw = raw or stream.read(CHUNK)
            if not raw:
                if started:
                    raise ValueError("a WARC file ends within a record")
                return
            started = True
            head += member.decompress(raw, CHUNK)
            raw = member.unconsumed_tail or member.unused_data
            if headers is None:
                if b"\r\n\r\n" not in head:
                    continue
                top, _, head = head.partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                left, http = int(headers["Content-Length"]), headers["WARC-Type"] == "response"
            if http:
                if b"\r\n\r\n" not in head:
                    continue
                top, _, head = head.partition(b"\r\n\r\n")
                left, http = left - len(top) - 4, False
            while left and (len(head) >= CHUNK or len(head) >= left):
                data, head = head[: min(left, CHUNK)], head[min(left, CHUNK) :]
                left -= len(data)
                yield headers, number, data, not left
                number += 1
        if headers is not None and not number:
            yield headers, 0, b"", True


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The chunked record table, CHUNK_SCHEMA: payload_bytes and payload_digest cover the payload up to and with the chunk.

    An empty payload, and a revisit, has one empty chunk.
    """

    def page(urn: str | None) -> int | None:
        found = (urn or "null").strip("<>").removeprefix("urn:page:")
        return None if found == "null" else int(found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CHUNK_SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = file_system(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for headers, number, data, last in parse(stream):
                        if not number:
                            digest, size = hashlib.sha1(), 0
                        digest.update(data)
                        size += len(data)
                        url = headers.get("WARC-Target-URI")
                        rows.append((page(headers["WARC-Record-ID"]), url if url is None else unquote(url, errors="surrogatepass"), headers["WARC-Type"], page(headers.get("WARC-Refers-To")), number, last, data, size, digest.hexdigest(), headers["WARC-Payload-Digest"].removeprefix("sha1:")))
                        held += len(data) + 200
                        if held > 8 * CHUNK:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(read, CHUNK_SCHEMA)


def records_table(chunks: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per record: key, payload_bytes, payload_digest, record_type, refers_to; a revisit has those of the response it names and declares.

    An error if a response's payload has another digest than its record declares, or a revisit's response is missing.
    """
    whole = F.col("payload_digest") == F.col("declared_digest")
    ends, _ = store(
        chunks.where("is_last").select(
            F.col("record_id").alias(key), "payload_bytes",
            F.when((F.col("record_type") == "revisit") | whole, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of record "), F.coalesce(F.col("record_id").cast("string"), F.lit("null"))))).alias("payload_digest"),
            "record_type", "refers_to",
        ),
        "records",
    )
    wanted = ends.where("record_type = 'revisit'").select(F.col("refers_to").alias("h"), F.col("payload_digest").alias("d")).distinct()
    held = ends.where("record_type = 'response'").join(wanted, (F.col(key) == F.col("h")) & (F.col("payload_digest") == F.col("d")))
    held, _ = store(held.groupBy("h", "d").agg(F.max("payload_bytes").alias("full")), "responses")
    both = ends.join(small(held, SMALL_DIGESTS), (F.col("refers_to") == F.col("h")) & (F.col("payload_digest") == F.col("d")), "left")
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).when(F.col("full").isNotNull(), F.col("full")).otherwise(F.raise_error(F.lit("a revisit names no response with its payload")))
    return both.select(key, size.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def warc_round_trip(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Write the pages' archives, read them back, and return records_table.

    A null payload is empty; null urls have no header. Rows with a null key are responses unless another row
    with a key has their payload. Rows that repeat a key and its payload are all responses. An empty table
    gives an empty one. Other columns of any name are ignored.
    """
    return records_table(read_archives(pages.sparkSession, write_archives(pages, text, key, url)), key)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM m
"""
