"""Token counts of documents in flat token files without an index.

A file is a row of 16-bit little-endian numbers: the ids of a document's tokens plus one, then 0, the end-of-document
identifier; then the next document. The writer is Spark's text sink with that identifier as separator (rows are bytes,
the separator is two zero bytes), so files appear whole or not at all.

Counting knows nothing but the files, which may have any size: Spark's text source splits them into byte ranges, whose
pieces a task puts together again in their order. Ranges are cut into blocks; in a block one vectorised comparison finds
the pairs of zero bytes. Where a block starts, and so which pairs are separators and not halves of two tokens, tells the
prefix scan over the blocks of a file: it carries their lengths, numbers of separators and last bytes, nothing else. The
places of the separators meet the result of the scan by block. So a document, and even a token, may start in one block
and end in another.

Defined results: an empty text is a document of no tokens; null counts as empty; ids aren't read, so rows without one,
repeated rows and ties are documents like others, and extra columns can't clash; tokens after the last separator are a
document that is reported as not ended; an odd number of bytes is refused; empty files and folders have no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import loaded, vocabulary
from .common import pieces, shared_path, stored, texts, utf8

#: Tokens in a block, documents in a file that write() makes; the end-of-document identifier as the sink's separator.
BLOCK, DOCUMENTS, SEPARATOR = 1 << 20, 1 << 20, "\0\0"


def write(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS) -> None:
    """Token files of the texts in the order of the rows; the vocabulary must have fewer than 65,535 tokens."""
    lines = vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(vocabulary_path, lines)
        if len(words.at) > 65_535:
            raise ValueError("ids don't fit 16 bits")
        for batch in pieces(batches):
            ids, ends = words.encode(*utf8(batch.column("text")))
            data = (ids + 1).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[2 * a : 2 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], names=["ids"])

    flat = texts(docs, id_col, text_col).mapInArrow(run, "ids binary").select(F.col("ids").cast("string"))
    flat.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", documents).text(path)


FOUND = "file string, size bigint, start bigint, part int, bytes bigint, head int, last int, even array<int>, odd array<int>"


def zero_pairs(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A row for each block of the files in a folder: the byte range that it is a part of, its length, first and last byte,
    and where its pairs of zero bytes start, those at even places and those at odd ones."""
    meta = F.col("_metadata")
    pieces_of = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(path)
    rows = pieces_of.select(meta["file_name"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"), F.col("value").cast("binary").alias("piece"))
    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def searched(key: tuple, part: int, data: bytes) -> pa.RecordBatch:
        zero = np.frombuffer(data, np.uint8) == 0
        pairs = np.flatnonzero(zero[:-1] & zero[1:]).astype(np.int32)
        row = [*key, part, len(data), data[0], data[-1], pairs[pairs % 2 == 0], pairs[pairs % 2 == 1]]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size = None, 0, [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal part, held, size
            data = b"".join(held)
            end = len(data) if last else len(data) // (2 * block) * (2 * block)
            for k in range(0, end, 2 * block):
                yield searched(now, part, data[k : min(k + 2 * block, end)])
                part += 1
            held, size = [data[end:]], len(data) - end

        for batch in batches:
            keys = [batch.column(c) for c in ("file", "size", "start")]
            place = np.stack([keys[0].dictionary_encode().indices.to_numpy(), keys[2].to_numpy()])
            edges = [0, *(np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                key = tuple(c[a].as_py() for c in keys)
                if key != now:
                    if size:
                        yield from cut(True)
                    now, part, held, size = key, 0, [], 0
                # what the source split at; after a file's last piece it may be too much, but is no zero
                data = b"".join(x + b"\n" for x in batch.column("piece").slice(a, b - a).to_pylist())
                held.append(data)
                size += len(data)
                if size >= 8 * block:
                    yield from cut(False)
        if size:
            yield from cut(True)

    return rows.mapInArrow(run, FOUND)


def count(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, document, first_token, n_tokens, ended) for each document of the files in a folder; first_token counts 16-bit places."""
    found = stored(zero_pairs(spark, path, block), "blocks")
    order = Window.partitionBy("file").orderBy("start", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbers = [F.size(c).alias(f"n_{c}") for c in ("even", "odd")] + [F.try_element_at(c, F.lit(-1)).alias(f"end_{c}") for c in ("even", "odd")]
    summary = found.select("file", "size", "start", "part", "bytes", "head", "last", *numbers)
    # the prefix scan: where a block starts, whether a separator reaches into it, the separators before it and the last one's end
    at = F.coalesce(F.sum("bytes").over(before), F.lit(0))
    refused = F.when(F.col("size") % 2 == 1, F.raise_error(F.concat("file", F.lit(" has an odd number of bytes"))).cast("bigint"))
    scanned = summary.withColumn("at", F.coalesce(refused, at)).withColumn("is_odd", F.col("at") % 2 == 1)
    scanned = scanned.withColumn("split", F.coalesce(F.col("is_odd") & (F.lag("last").over(order) == 0) & (F.col("head") == 0), F.lit(False)))
    own = F.when(F.col("is_odd"), F.col("end_odd")).otherwise(F.col("end_even"))
    end = F.coalesce(F.col("at") + own + 2, F.when(F.col("split"), F.col("at") + 1))
    n = F.when(F.col("is_odd"), F.col("n_odd")).otherwise(F.col("n_even")) + F.col("split").cast("int")
    scanned = scanned.withColumns({"n": n.cast("bigint"), "end": end})
    open_ = F.coalesce(F.max("end").over(before), F.lit(0))
    is_last = F.lead("start").over(order).isNull()
    scanned = scanned.withColumns({"documents": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": open_, "is_last": is_last})
    scanned = stored(scanned.select("file", "size", "start", "part", "at", "is_odd", "split", "n", "end", "documents", "open", "is_last"), "scan")

    both = found.select("file", "start", "part", "even", "odd").join(scanned.where("n > 0"), ["file", "start", "part"])
    inside = F.transform(F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even")), lambda q: F.col("at") + q)
    places = F.when(F.col("split"), F.concat(F.array(F.col("at") - 1), inside)).otherwise(inside)
    each = both.select("file", "documents", "open", places.alias("places")).select("file", "documents", "open", "places", F.posexplode("places").alias("k", "place"))
    first = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("places", F.col("k") - 1) + 2)
    half = lambda c: F.floor(c / 2).cast("bigint")
    ended = each.select("file", (F.col("documents") + F.col("k")).alias("document"), half(first).alias("first_token"), half(F.col("place") - first).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.coalesce("end", "open")
    tail = scanned.where("is_last").select("file", (F.col("documents") + F.col("n")).alias("document"), half(rest).alias("first_token"), half(F.col("size") - rest).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail.where("n_tokens > 0"))


def written_and_counted(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """count() over the files that write() makes of docs."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary_path)
    return count(docs.sparkSession, path)
