"""WARC archives with Zstandard: written by Spark to the shared folder, and read back.

An archive starts with a skippable frame that holds the dictionary; then comes one frame for each record. A task fills an
archive until it has about SIZE bytes or RECORDS records, and hands it to Spark's own text sink as one row and one file, so
files appear whole or not at all, also when tasks are repeated; what the sink puts after a row is an empty skippable frame,
which readers of Zstandard pass over. A file is larger than SIZE only by its last record.

Of records with equal payloads of at least LEAST bytes, that with the smallest id is a response and the others revisit
it: they carry the digest and the response's record id, and the length in their HTTP headers, but no payload.

Reading checks the version, the mandatory headers, each block's length, the digest and length of each payload, and that
a frame holds just one record.

Defined results: null html is an empty payload and empty payloads are responses; pages with equal ids are records of
their own, those with the smallest id of equal payloads are all responses; a page without an id gets a record id from its
digest, which page_of() reads as none, and is a response unless a page with an id has its payload; other columns are not
read; an empty table makes archives without records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored
from .labelled import least_hashes

LEAST, RECORDS, SIZE, SAMPLE, DICTIONARY = 100, 1 << 16, 32 << 20, 400, 32 << 10
#: Fixed values of the format: the magic number of a dictionary's skippable frame, of an empty one between records, the
#: magic number of a Zstandard frame, the version line, the profile of revisits.
DICTIONARY_MAGIC, BETWEEN, FRAME_MAGIC = 0x184D2A5D, struct.pack("<II", 0x184D2A50, 0).decode("ascii"), 0xFD2FB528
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Upper halves of record ids: of pages with an id, which is the lower half, and of those without.
PAGE, NAMELESS = 0x70616765_0000_8000, 0x6E6F6964_0000_8000


def record_id(page_id: int | None, digest: str = "") -> str:
    """A record id that keeps the page id in its last 64 bits; a page without an id gets one from its digest."""
    high, low = (PAGE, page_id) if page_id is not None else (NAMELESS, int(digest[:16] or "0", 16))
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | (low & ((1 << 64) - 1)))}>"


def page_of(name: str) -> int | None:
    high, low = divmod(uuid.UUID(name.removeprefix("<urn:uuid:").removesuffix(">")).int, 1 << 64)
    return None if high == NAMELESS else low - (1 << 64) if low >> 63 else low


def page_column(name: str) -> Column:
    """page_of() of a column."""
    digits = F.regexp_replace(name, "[-<>]", "")
    low = F.conv(F.right(digits, F.lit(16)), 16, -10).cast("long")
    return F.when(~digits.contains(f"{NAMELESS:016x}"), low)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record of the response refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c > " ") or "about:blank"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", target), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def headed(data: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    """First line, headers (lower case) and the rest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError(f"{what} without an end of headers")
    first, *lines = head.split(b"\r\n")
    headers = {}
    for x in lines:
        name, colon, value = x.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"{what} with a malformed header")
        headers[name.strip().lower()] = value.strip()
    return first, headers, rest


def parsed(data: bytes) -> dict:
    """The record in a frame, checked."""
    version, headers, rest = headed(data, "a record")
    if version != VERSION:
        raise ValueError("a record of another version")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"a record without {', '.join(sorted(missing))}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a block of {n} bytes doesn't fill its frame of {len(rest)}")
    _, http, payload = headed(rest[:n], "a block")
    digest, size = headers.get("warc-payload-digest", "").removeprefix("sha256:"), int(http["content-length"])
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't fit its length or digest")
    if headers["warc-type"] == "revisit" and (payload or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE):
        raise ValueError("a revisit needs the record that it refers to, a profile, and no payload")
    return {"record_id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"], "refers_to": headers.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload if headers["warc-type"] == "response" else None}


def frame_end(view: memoryview, at: int) -> int:
    """Where the Zstandard frame at a place ends, by its header and the headers of its blocks; nothing is decompressed."""
    head = view[at : at + 18]
    try:
        checked = zstandard.get_frame_parameters(head).has_checksum
        at += zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise ValueError("an archive with a frame without a header") from e
    last = False
    while not last:
        block = int.from_bytes(view[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)  # a block of one byte repeated holds it once
        if at > len(view):
            break
    at += 4 * checked
    if at > len(view):
        raise ValueError("an archive ends within a frame")
    return at


def frames(archive: bytes) -> Iterator[bytes]:
    """The content of each frame, by the dictionary of the leading skippable frame. Each byte of an archive is read once."""
    at, view, reader = 0, memoryview(archive), zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) - at < 8:
            raise ValueError("an archive ends within a frame")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic >> 4 == DICTIONARY_MAGIC >> 4:
            if at + 8 + size > len(archive):
                raise ValueError("an archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(view[8 : 8 + size])
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == struct.pack("<I", FRAME_MAGIC) else raw
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("an archive with bytes that are no frame")
        end, one = frame_end(view, at), reader.decompressobj()
        try:
            out = one.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError("an archive with a frame that can't be decompressed") from e
        if not one.eof or one.unused_data:
            raise ValueError("an archive ends within a frame")
        at = end
        yield out


def dictionary(pages: DataFrame, payload_col: str = "payload", sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from a bounded sample: the payloads, up to 64 kB of each, with the least hashes; or none from few or poor ones.

    Of equal payloads one counts. Only hashes below a bound that about 2 * sample reach are ordered, so no task sends many.
    """
    full = pages.where(F.length(payload_col) > 0).select(F.xxhash64(payload_col).alias("h"), payload_col)
    n = full.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    some = full.where(F.col("h") <= least_hashes(n, sample)).groupBy("h").agg(F.first(F.substring(payload_col, 1, 1 << 16)).alias("p"))
    rows = some.orderBy("h").limit(sample).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["p"]) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, path: str, least: int = LEAST, date: str | None = None, records: int = RECORDS, size: int = SIZE) -> None:
    """Archives of pages (page_id, url, html) as files in a folder."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    every = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.length("payload") >= least
    shared = every.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared = stored(shared, "shared-payloads")
    revisit = long & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id")))
    linked = every.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))
    trained = spark.sparkContext.broadcast(dictionary(every))  # of DICTIONARY bytes at most
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(trained.value) if trained.value else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)
        head = trained.value and struct.pack("<II", DICTIONARY_MAGIC, len(trained.value)) + trained.value
        held, held_size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head + b"".join(held)], pa.binary())], names=["archive"])

        for batch in batches:
            for k in range(0, len(batch), 100):
                for r in batch.slice(k, 100).to_pylist():
                    held.append(writer.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)))
                    held_size += len(held[-1])
                    if held_size >= size or len(held) >= records:
                        yield archive()
                        held, held_size = [], 0
        if held:
            yield archive()

    # bytes go through the text sink as they are
    linked.mapInArrow(run, "archive binary").select(F.col("archive").cast("string")).write.option("lineSep", BETWEEN).option("maxRecordsPerFile", 1).text(path)


FOUND = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder; payload is null for revisits. An invalid record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [x.split(" ")[0] for x in FOUND.split(", ")]
        for batch in batches:
            for k in range(len(batch)):
                rows, size = [], 0
                for data in frames(batch.column("content")[k].as_py()):
                    rows.append(parsed(data))
                    size += len(data)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """What read() finds in the archives that write() makes of pages."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


#: DuckDB SQL of the registered query.
ORACLE = f"""
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM page),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND first < page_id THEN first END AS refers_to
FROM first
"""
