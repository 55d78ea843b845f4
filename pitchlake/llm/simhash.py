"""SimHash fingerprints, and near duplicates among them by anchor-point covering.

Anchors are the words of a product of three perfect binary codes over 61 of the 64 bits: two Golay codes of length 23 and
covering radius 3, and a Hamming code of length 15 and covering radius 1. Every point lies within the covering radius of
exactly one code word of a block. Two fingerprints that differ in 3 bits at most have a point between them that is 1 bit
from the one and 2 from the other, and its anchor is within the radius plus that share of the threshold of both. So each
fingerprint is replicated to every anchor within the radius plus 2 bits (over all blocks together), some 150, and in an
anchor's group those within the radius plus 1, some 16, are compared with all: no link is missed. There are 2^35 anchors:
of 10^10 fingerprints that are spread evenly a group has 45.

Fingerprints are compared once, however many documents share them. A group of about GROUP rows or more is split into chunks
of half as many, and each pair of chunks is compared by itself. How large groups are is told from a sample by hash, in which
a group of GROUP rows has SHOWN; so replicas are made once, and an odd sample changes only how even the tasks are, never
what is compared. Of the links in a large group a spanning forest goes on, not all pairs.

Defined results: null counts as empty; texts without words have fingerprint zero and link like any other; repeated rows
get equal results; rows without an id are linked like others, and have no say in the least id (a component without any id
has none); only id and text are read, so extra columns can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts
from .components import components

#: Words in a shingle, seed of its hash, differing bits of linked fingerprints, rows of a group that one task compares.
SHINGLE, SEED, THRESHOLD, GROUP = 3, 42, 3, 4096
#: Fingerprints of a group of GROUP rows from which its size is told.
SHOWN = 64
#: Fixed values of perfect binary codes: length, covering radius, generator polynomial; of each block of bits.
GOLAY, HAMMING = (23, 3, 0b110001110101), (15, 1, 0b10011)
BLOCKS = (GOLAY, GOLAY, HAMMING)


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes, so of A-Z and ASCII white space alone
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, for each row."""
    slim = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.encode()) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def syndrome(words: np.ndarray, code: tuple[int, int, int]) -> np.ndarray:
    """Remainders of words by a code's generator; zero for code words."""
    length, _, generator = code
    degree, left = generator.bit_length() - 1, words.astype(np.int64)
    for bit in range(length - 1, degree - 1, -1):
        left = np.where(left >> bit & 1, left ^ (generator << (bit - degree)), left)
    return left


@lru_cache(4)
def errors(code: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For an excess of 0, 1 and 2 bits over the radius: the patterns from a word to its code words, by syndrome, and their offsets."""
    length, radius, generator = code
    out = []
    for weights in (range(radius + 1), (radius + 1,), (radius + 2,)):
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(length), w)], np.int64)
        of = syndrome(patterns, code)
        order = np.argsort(of, kind="stable")
        syndromes = 1 << generator.bit_length() - 1
        out.append((patterns[order], np.searchsorted(of[order], np.arange(syndromes + 1))))
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fps, anchor, excess) for all anchors within the radius plus 2 bits."""
    shifts = np.cumsum([0, *(length for length, _, _ in BLOCKS)]).tolist()
    words = [(fps >> shift) & ((1 << code[0]) - 1) for shift, code in zip(shifts, BLOCKS)]
    found = [syndrome(w, code) for w, code in zip(words, BLOCKS)]
    rows = ([], [], [])
    for excess in product(range(3), repeat=len(BLOCKS)):
        if sum(excess) > 2:
            continue
        tables = [errors(code)[e] for code, e in zip(BLOCKS, excess)]
        counts = [at[s + 1] - at[s] for (_, at), s in zip(tables, found)]
        size = np.prod(counts, axis=0)
        of = np.repeat(np.arange(len(fps)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        anchor = np.zeros(len(of), np.int64)
        for word, (patterns, at), s, n, shift in zip(words, tables, found, counts, shifts):
            k, digit = np.divmod(k, np.maximum(n, 1)[of])
            anchor |= (word[of] ^ patterns[at[s][of] + digit]) << shift
        for x, y in zip(rows, (of, anchor, np.full(len(of), sum(excess), np.int64))):
            x.append(y)
    return tuple(np.concatenate(x) for x in rows)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD


def forest(fps: np.ndarray, probe: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group, as stars around the least member of each part. side: 0 and 1 are compared with each other alone, if both occur."""
    root, two = np.arange(len(fps)), len(np.unique(side)) > 1
    for at in range(0, len(fps), 256):
        own = slice(at, at + 256)
        if not probe[own].any():
            continue
        near = linked(fps[own][:, None], fps[None, :]) & probe[own][:, None]
        if two:
            near &= side[own][:, None] != side[None, :]
        i, j = np.nonzero(near)
        i += at
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            for k in (root[i], root[j]):
                np.minimum.at(root, k, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
    out = root != np.arange(len(fps))
    return fps[root[out]], fps[out]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) in rows (anchor, i, j, chunk, fp, probe) that are sorted by anchor, i and j."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j", "chunk", "fp", "probe")]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
            cut = int(new[-1]) if len(new) else 0
            rest, full = [x[cut:] for x in now], [x[:cut] for x in now]  # the last group may go on
        else:
            rest, full = None, rest
        if full is None or not len(full[0]):
            continue
        anchor, i, j, chunk, fp, probe = full
        starts = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1])
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[group] <= 64
        a, b = [], []
        for k in range(1, min(64, int(sizes.max()))):
            x = np.flatnonzero((group[:-k] == group[k:]) & small[:-k] & (probe[:-k] | probe[k:]))
            x = x[linked(fp[x], fp[x + k])]
            a.append(fp[x])
            b.append(fp[x + k])
        for g in np.flatnonzero(sizes > 64).tolist():
            own = slice(starts[g], starts[g] + sizes[g])
            p, q = forest(fp[own], probe[own].astype(bool), chunk[own] == j[own] if i[own][0] != j[own][0] else np.zeros(sizes[g], bool))
            a.append(p)
            b.append(q)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links between the distinct fingerprints of fps (column fp) that connect all that 3 or fewer bits connect."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy()
            for k in range(0, len(own), 1024):
                of, word, excess = anchors(own[k : k + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(own[k : k + 1024][of]), pa.array(excess <= 1)], names=["anchor", "fp", "probe"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a small table becomes a large one here, so its few partitions are dealt out first
    own, replicas = fps.select("fp").repartition(n, "fp"), "anchor bigint, fp bigint, probe boolean"
    rows = own.mapInArrow(replicate, replicas)
    # sizes of groups only say how they are cut into tasks, so one fingerprint in `each` tells them well enough
    each = max(1, group // SHOWN)
    some = own.where(F.pmod(F.xxhash64("fp"), F.lit(each)) == 0).mapInArrow(replicate, replicas)
    sizes = some.groupBy("anchor").agg((F.count("*") * each).alias("count"))
    large = stored(sizes.where(F.col("count") > group // 2), "anchors")
    n_large = large.count()
    alone = rows.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "fp", "probe")
    if n_large:
        large = F.broadcast(large) if n_large <= 1_000_000 else large
        chunks = F.ceil(2 * F.col("count") / group).cast("int")
        known = rows.join(large, "anchor", "left").withColumn("chunk", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), chunks).cast("int")))
        alone = known.select("anchor", "chunk", "fp", "probe", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))).alias("other")).select(
            "anchor", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp", "probe"
        )
    return alone.repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the least doc_id among all that links reach, for each row."""
    own = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    roots = stored(components(links(distinct)), "roots").select(F.col("v").alias("fp"), "root")
    classes = stored(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc"), "classes")
    least = stored(classes.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    classes = stored(classes.join(least, "root").select("fp", "component_id"), "classes")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")
