import hashlib
import os
import struct
import time

import pytest
import zstandard

from pitchlake.llm import queries, warc
from pitchlake.llm.common import shared_path


def brute(rows):
    out = []
    for i, html in rows:
        p = (html or "").encode()
        first = min((j for j, h in rows if (h or "").encode() == p and j is not None), default=None)
        revisit = len(p) >= 100 and first is not None and (i is None or first < i)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(found):
    number = lambda x: x and warc.page_of(x)
    return sorted(((warc.page_of(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found.collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op4_warc_zstd(spark, sf).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    same, tiny = "<p>ünï</p>" * 20, "<p>x</p>"
    rows = [(5, same), (3, same), (3, same), (9, None), (1, ""), (7, tiny), (8, tiny), (-4, "w" * 2_000_000), (6, "\r\n\r\nWARC/1.1\r\n" * 20), (None, same), (None, tiny), (None, "only without an id " * 9), (None, "only without an id " * 9), (None, None)]
    pages = spark.createDataFrame([(i, f"http://e.example/{i}\r\nX: y", h, 0) for i, h in rows], "page_id bigint, url string, html string, payload int")
    assert got(warc.round_trip(pages)) == brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files_start_with_the_dictionary_and_have_a_frame_for_each_record(spark):
    pages = spark.createDataFrame([(i, "http://e.example/", f"<html><body><h1>Title {i}</h1>" + f"<p>Paragraph {i * 7919 % 1000} of the page</p>" * 30) for i in range(300)], "page_id bigint, url string, html string")
    path = shared_path(spark, "warc")
    warc.write(pages, path, records=20)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert all(struct.unpack_from("<I", f)[0] == 0x184D2A5D for f in files if len(f)) and len(files) >= 15 and sum(len(list(warc.frames(f))) for f in files) == 300
    payloads = {r.page_id: r.html for r in pages.collect()}
    assert {warc.page_of(r.record_id): bytes(r.payload).decode() for r in warc.read(spark, path).collect()} == payloads


def test_files_are_bounded_by_bytes(spark):
    pages = spark.createDataFrame([(i, "u", os.urandom(3000).hex()) for i in range(100)], "page_id bigint, url string, html string").coalesce(1)
    path = shared_path(spark, "warc")
    warc.write(pages, path, size=40_000)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 40_000 + warc.DICTIONARY + 5000 and warc.read(spark, path).count() == 100
    assert [warc.page_of(warc.record_id(i, "ff")) for i in (5, -5, None)] == [5, -5, None]


def test_invalid_archives_are_refused():
    good = warc.record(1, "http://e.example/", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)["payload"] == b"hello"
    for bad in (good.replace(b"hello", b"hullo"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good + good, good.replace(b"Content-Length: 5", b"Content-Length: 6")):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    frame = zstandard.compress(good)
    assert list(warc.frames(struct.pack("<II", 0x184D2A50, 3) + b"abc" + frame)) == [good]
    for bad in (frame[:-3], frame + b"junkjunkjunk", struct.pack("<II", 0x184D2A50, 99)):
        with pytest.raises(ValueError):
            list(warc.frames(bad))


def test_large_archives_are_read_in_proportion():
    """Twenty thousand records in one archive; blocks that repeat a byte, aren't compressed, and are several in a frame."""
    odd = [b"a" * 300_000, os.urandom(300_000), b"", b"x", os.urandom(1000) * 400]
    contents = [*odd, *(b"record %d " % i + os.urandom(500) for i in range(20_000))]
    writers = [zstandard.ZstdCompressor(write_checksum=c, write_content_size=s) for c in (True, False) for s in (True, False)]
    archive = b"".join(writers[i % 4].compress(c) for i, c in enumerate(contents))
    began = time.time()
    assert list(warc.frames(archive)) == contents
    assert time.time() - began < 5
