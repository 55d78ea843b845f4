"""Runs of periodic words in texts, by block convolution.

Words are numbered within their text, and several texts are laid end to end as one sequence of numbers in which no text
shares a number with another, so no run reaches from one into the next. At each scale B (a power of two) the sequence is
cut into blocks of B words, and a block is held against the window of 2B - 1 words that follows it: the sum of squared
differences at each distance from B to 2B - 1 is the block's sum of squares, plus a running sum of the window's, less twice
a convolution, which a number-theoretic transform gives in exact integers. A distance with sum zero is an occurrence
without a mismatch. Numbers are held against each other in digits, few enough bits each that a sum stays below the prime.

A run of period q in [B, 2B) and length 4q at least has two neighbouring whole blocks that recur at distance q, so only
distances that two neighbouring blocks share seed a run, and it ends less than a block before the first and behind the last
of its blocks: each seed is extended by a comparison of two stretches of B words. By the theory of repetitions a sequence of n
words has O(n / B) such seeds with a primitive period, and all others lie within runs that smaller scales have found.

Blocks are left out of the transform where they can't seed a new run: a block with a word that doesn't recur within 2B words,
and two neighbours that lie within a run found before. What remains costs O(n log n) at a scale at worst, for any text.

Defined results: null counts as empty; an empty text has no runs and an empty collapsed text; repeated rows get equal
results; rows without an id are treated like others; only id and text are read, so extra columns can't clash; an empty
table gives an empty one. Texts are taken whole; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts, utf8

#: Times that a period occurs in a run at least, words of a run at least.
TIMES, LEAST = 4, 6
#: Fixed values of the transform: a prime of which a large power of two divides the predecessor, and a primitive root of it.
PRIME, ROOT = 15 * (1 << 27) + 1, 31
#: Words of texts that are laid end to end; numbers that one transform holds.
SEQUENCE, BATCH = 1 << 17, 1 << 18


@lru_cache(64)
def roots(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of this order."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(max(1, size // 2), np.uint64)
    n = 1
    while n < len(out):
        out[n : 2 * n] = out[:n] * np.uint64(pow(root, n, PRIME)) % np.uint64(PRIME)
        n *= 2
    return out


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform down the columns of x (size, n), in an order of its own that the inverse takes back."""
    size, n, p = *x.shape, np.uint64(PRIME)
    halves = [1 << k for k in range(size.bit_length() - 1)]
    for half in halves if inverse else reversed(halves):
        x = x.reshape(size // (2 * half), 2, half, n)
        a, b, w = x[:, 0], x[:, 1], roots(2 * half, inverse)[:, None]
        out = np.empty_like(x)
        if inverse:
            b = b * w % p
            out[:, 0], out[:, 1] = (a + b) % p, (a + (p - b)) % p
        else:
            out[:, 0], out[:, 1] = (a + b) % p, (a + (p - b)) * w % p
        x = out
    x = x.reshape(size, n)
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % p if inverse else x


def without_mismatch(x: np.ndarray, blocks: np.ndarray, scale: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) for the occurrences of blocks at distances from scale to 2 * scale - 1, all inside x. bits: of the numbers in x."""
    width = max(1, (PRIME.bit_length() - scale.bit_length()) // 2)  # scale * (2**width - 1)**2 stays below the prime
    found = ([], [])
    for k in range(0, len(blocks), step := max(1, BATCH // (2 * scale))):
        own, alive = blocks[k : k + step], None
        for shift in range(0, bits, width):
            at = own * scale
            block = x[at[None, :] + np.arange(scale)[:, None]] >> shift & ((1 << width) - 1)
            place = at[None, :] + scale + np.arange(2 * scale - 1)[:, None]
            window = np.where(place < len(x), x[np.minimum(place, len(x) - 1)] >> shift & ((1 << width) - 1), 0)
            a, b = np.zeros((2 * scale, len(own)), np.uint64), np.zeros((2 * scale, len(own)), np.uint64)
            a[:scale], b[: 2 * scale - 1] = block[::-1], window
            product = transform(transform(a) * transform(b) % np.uint64(PRIME), inverse=True)[scale - 1 : 2 * scale - 1].astype(np.int64)
            squares = np.cumsum(np.concatenate([np.zeros((1, len(own)), np.int64), window * window]), axis=0)
            zero = (block * block).sum(axis=0) + squares[scale:] - squares[:scale] - 2 * product == 0
            zero &= place[:scale] + scale <= len(x)
            alive = zero if alive is None else alive & zero
            some = alive.any(axis=0)
            own, alive = own[some], alive[:, some]
            if not len(own):
                break
        if len(own):
            i, d = np.nonzero(alive.T)
            found[0].append(own[i])
            found[1].append(d + scale)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def recurrence(x: np.ndarray) -> np.ndarray:
    """The distance from each place to the next one with the same number; over len(x) where there is none."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), 2 * len(x) + 2, np.int64)
    same = x[order[:-1]] == x[order[1:]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The number of leading places at which a and b agree."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def periodic_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs in a sequence of numbers from 0, of TIMES periods and LEAST places at least."""
    n = len(x)
    if n < LEAST:
        return []
    bits = max(1, int(x.max()).bit_length())
    farthest = recurrence(x)  # of the places of a block, the farthest recurrence
    runs: list[tuple[int, int, int]] = []
    reach = np.zeros(n + 1, np.int64)  # how far the runs that start at a place or before it reach
    scale = 1
    while TIMES * scale <= n:
        live = farthest < 2 * scale
        first = np.flatnonzero(live[:-1] & live[1:])  # of two neighbours
        first = first[reach[first * scale] < (first + 2) * scale]
        if len(first):
            blocks = np.union1d(first, first + 1)
            block, distance = without_mismatch(x, blocks, scale, bits)
            order = np.lexsort((block, distance))
            block, distance = block[order], distance[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 1) | (np.diff(distance) != 0)])) if len(block) else np.zeros(0, np.int64)
            size = np.diff(np.append(new, len(block)))
            found = set()
            for k, m in zip(new[size > 1].tolist(), size[size > 1].tolist()):
                start, period = int(block[k]) * scale, int(distance[k])
                end = start + m * scale  # of the places that agree with those a period later
                if reach[start] >= end + period:
                    continue
                low = max(0, start - scale)
                start -= agreeing(x[low:start][::-1], x[low + period : start + period][::-1])
                end += agreeing(x[end : end + scale], x[end + period : end + period + scale])
                if end + period - start >= max(LEAST, TIMES * period):
                    found.add((start, end + period - start, period))
            if found:
                runs += found
                for start, length, _ in found:
                    reach[start] = max(reach[start], start + length)
                reach = np.maximum.accumulate(reach)
        scale *= 2
        half = len(farthest) // 2
        farthest = np.maximum(farthest[0 : 2 * half : 2], farthest[1 : 2 * half : 2])
        if half < 2:
            break
    return sorted(runs, key=lambda r: (r[0], r[2]))


RUNS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_TYPES = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]


def _found(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, which are laid end to end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    x, base = np.zeros(int(sizes.sum()), np.int64), 0
    ends = np.cumsum(sizes)
    for own, end in zip(words, ends.tolist()):
        known: dict[bytes, int] = {}
        x[end - len(own) : end] = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
        x[end - len(own) : end] += base
        base += len(known)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, length, period in periodic_runs(x):
        k = int(np.searchsorted(ends, start, side="right"))
        out[k].append((start - int(ends[k] - sizes[k]), length, period))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period; numbers of words from 0) and collapsed, the text without repetitions, for each row.

    A run is a longest stretch of words in which words `period` apart are equal, for the least such period, that has
    max(LEAST, TIMES * period) words at least. Of each run `collapsed` keeps the first period; words are joined by one space.
    """
    slim = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, at = utf8(batch.column("text"))
            words = [data[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]  # ASCII white space alone
            found: list[list[tuple[int, int, int]]] = []
            held: list[list[bytes]] = []
            size = 0
            for own in [*words, None]:
                if held and (own is None or size + len(own) > SEQUENCE):
                    found += _found(held)
                    held, size = [], 0
                if own is not None:
                    held.append(own)
                    size += len(own)
            columns = [[len(w) for w in words], [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], [_collapsed(w, f).decode() for w, f in zip(words, found)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, _TYPES)], names=["doc_id", "n_words", "runs", "collapsed"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {RUNS}")


def longest(runs: Column) -> Column:
    """The longest run; of several the first, then that of the least period. Null for none."""
    key = lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    return F.array_min(F.transform(runs, key))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text; by a checksum of the id every tenth text is made periodic from some word on. Rows without an id stay as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+"), 0)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        # the period is laid out once too often and cut behind the last word
        laid = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), laid), F.lit(1), n), " ")).otherwise("")

    w = F.transform(F.array(words), planted)[0]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(w, F.lit(""))).otherwise(F.col(f"`{text_col}`")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    best = longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: DuckDB SQL of the registered query: pairs of equal triples of words at equal distances, instead of blocks.
ORACLE = rf"""
WITH
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
summed AS (
  SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT))),
    lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) AS h FROM split, crc),
placed AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM summed),
spaced AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM spaced),
triples AS (SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(n - 2)) AS i FROM docs WHERE n >= {LEAST})),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM triples a JOIN triples b ON a.doc_id = b.doc_id AND a.g = b.g AND b.i > a.i AND {TIMES} * (b.i - a.i) <= a.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM islands GROUP BY doc_id, q, k HAVING count(*) + 2 + q >= greatest({LEAST}, {TIMES} * q)),
runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
told AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'l': l, 'q': q}}, {{'k': -l, 's': s, 'q': q}}) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    list({{'a': s + q, 'b': s + l}}) AS gone FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(range(n), w), lambda e: len(list_filter(gone, lambda g: e[1] >= g.a AND e[1] < g.b)) = 0), lambda e: e[2]) END, ' ')) AS collapsed_sha256
FROM docs d LEFT JOIN told USING (doc_id)
"""
