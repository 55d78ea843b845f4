"""Document fingerprints from the phrases of a Lempel-Ziv parse.

A text is parsed into the shortest phrases that its dictionary doesn't hold yet (LZ78). The set of phrases is hashed,
and a signature keeps the least hash under each of K keyed mixings. The share of equal places of two signatures
estimates the Jaccard likeness of the phrase sets, which like compressed size is high where texts share long stretches.

Defined results: null counts as the empty text; empty texts have equal fingerprints and are 1.0 like each other and 0.0
like any other text; equal texts have equal fingerprints. Documents follow each other by ascending doc_id, rows with
equal doc_id by a hash of the text, rows without an id first; the last is followed by the first, a single one by itself.
Only id and text are read, so extra columns can't clash; an empty table gives an empty one. Texts are parsed whole.
with_edits() orders by whole numbers of 64 bits; text that is no such number ends the job, as no order is defined for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .labelled import least_hashes

#: Places of a signature; what stands for a null id among 64-bit ones.
PLACES, NONE = 128, -(1 << 63)
#: Keys a run from which the ranges of the runs are told.
EACH = 20
_RNG = np.random.default_rng(20)
MIX_XOR, MIX_MUL = _RNG.integers(0, 1 << 32, PLACES, np.uint32), _RNG.integers(0, 1 << 31, PLACES, np.uint32) * np.uint32(2) + np.uint32(1)
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parse(head: str, tails: list[str]) -> list[list[int]]:
    """Lengths of the phrases of head + tail for each of tails; the head is parsed once."""
    known: set[str] = set()
    phrase, sizes = "", []
    for c in head:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            sizes.append(len(phrase))
            phrase = ""
    out, pending = [], phrase
    for tail in tails:
        own: set[str] = set()
        phrase, more = pending, []
        for c in tail:
            phrase += c
            if phrase not in known and phrase not in own:
                own.add(phrase)
                more.append(len(phrase))
                phrase = ""
        out.append([*sizes, *more, *([len(phrase)] if phrase else [])])
    return out


def phrase_hashes(text: str, sizes: list[int], powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """32-bit hashes of consecutive phrases of a text, from the prefix sums of one polynomial."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points + np.uint64(1)) * powers[0][: len(points)], out=sums[1:])
    ends = np.cumsum(np.array(sizes, np.int64))
    starts = ends - sizes
    return (mixed((sums[ends] - sums[starts]) * powers[1][starts]) >> np.uint64(32)).astype(np.uint32)


class Signer:
    """Signatures of many texts at once; keeps the powers of the polynomial's base."""

    def __init__(self) -> None:
        self.powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def sign(self, parsed: list[tuple[str, list[int]]]) -> np.ndarray:
        """A row of PLACES minima, hashed to 16 bits, for each (text, lengths of its phrases); all ones for an empty text."""
        out = np.full((len(parsed), PLACES), 0xFFFF, np.uint16)
        most = max((len(t) for t, _ in parsed), default=0)
        if most >= len(self.powers[0]):
            n = np.full(2 * most, BASE, np.uint64), np.full(2 * most, INVERSE, np.uint64)
            for x in n:
                x[0] = 1
            self.powers = tuple(np.cumprod(x) for x in n)
        full = [i for i, (t, _) in enumerate(parsed) if t]
        if full:
            hashes = [phrase_hashes(*parsed[i], self.powers) for i in full]
            starts = np.cumsum([0, *(len(h) for h in hashes[:-1])])
            flat = np.concatenate(hashes)
            for k in range(PLACES):
                least = np.minimum.reduceat((flat ^ MIX_XOR[k]) * MIX_MUL[k], starts)
                out[full, k] = least * np.uint32(0x9E3779B1) >> np.uint32(16)  # minima are small: their low bits tell them apart
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of equal places beyond those that agree by chance."""
    equal = (a == b).mean(axis=1)
    return np.where(equal == 1, 1.0, np.clip((equal - 2**-16) / (1 - 2**-16), 0, 1))


def edited(text: str, following: str) -> tuple[str, str]:
    """The part of a text that stays, and what replaces its last quarter."""
    cut = len(text) // 4
    return text[: len(text) - cut], following[:cut]


SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal) for each row."""
    slim = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            rows = [(t, parse(t, [""])[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(">u2").tobytes().hex() for x in signer.sign(rows)], pa.string())], names=["doc_id", "fingerprint"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def run_of(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """How many of the cuts are less than each key; keys and cuts are columns, cuts in ascending order."""
    low, high = (np.searchsorted(cuts[0], keys[0], side=side) for side in ("left", "right"))
    if len(keys) > 1:
        for x in np.unique(keys[0][high > low]):
            own = keys[0] == x
            a, b = int(np.searchsorted(cuts[0], x)), int(np.searchsorted(cuts[0], x, side="right"))
            low[own] += run_of([k[own] for k in keys[1:]], [c[a:b] for c in cuts[1:]])
    return low


def range_cuts(keys: DataFrame, runs: int) -> list[np.ndarray]:
    """At most runs - 1 keys (doc_id, tie) that part the rows evenly, from some EACH keys a run with the least hashes."""
    hashed = F.xxhash64("doc_id", "tie")
    rows = keys.where(hashed <= least_hashes(keys.count(), EACH * runs)).select("doc_id", "tie").collect()
    found = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 2)
    found = np.unique(found, axis=0)  # ascending
    picks = np.unique(np.arange(1, runs) * len(found) // runs)
    return [found[picks, k] for k in (0, 1)] if len(found) else [np.zeros(0, np.int64)] * 2


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter comes from the next document.

    The texts are shuffled once, into runs of consecutive (doc_id, tie), 4 for each shuffle partition; so an id of very
    many rows fills several runs. Each run also gets the first document of the next one, so that no task needs more than
    its own rows, of which it holds one batch. Equal rows stay in one run, where each pair of texts is parsed once.
    """
    spark = docs.sparkSession
    slim = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = range_cuts(slim, runs)

    @F.pandas_udf("int")
    def run(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(run_of([ids.to_numpy(), ties.to_numpy()], cuts).astype(np.int32))

    slim = slim.withColumn("run", run("doc_id", "tie"))
    firsts = slim.groupBy("run").agg(F.min(F.struct("doc_id", "tie")).alias("head")).orderBy("run").collect()  # a row for each run
    if not firsts:
        return slim.select("doc_id", *(F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in SCHEMA.split(", ")))
    heads = [(head["head"]["doc_id"], head["head"]["tie"], before["run"]) for before, head in zip([firsts[-1], *firsts], firsts)]
    later = spark.createDataFrame(heads, "doc_id bigint, tie bigint, to_run int")
    copies = slim.join(F.broadcast(later), ["doc_id", "tie"]).select("doc_id", "text", "tie", F.col("to_run").alias("run"), F.lit(True).alias("guest"))
    own = slim.select("doc_id", "text", "tie", "run", F.lit(False).alias("guest"))
    dealt = own.unionByName(copies).repartition(runs, "run").sortWithinPartitions("run", "guest", "doc_id", "tie")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, held = Signer(), None

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text")))

        def settle(pairs: list[tuple]) -> pa.RecordBatch:
            """pairs: a document's id, its text, and the text after it."""
            known = {p[1:]: None for p in pairs}  # equal pairs once
            own, changed, follow = [], [], []
            for text, following in known:
                stays, tail = edited(text, following)
                a, b = parse(stays, [text[len(stays) :], tail])
                own.append((text, a))
                changed.append((stays + tail, b))
            # most texts that follow are the own text of the next pair
            at = {text: k for k, (text, _) in enumerate(known)}
            more = list(dict.fromkeys(following for _, following in known if following not in at))
            signs = signer.sign([*own, *((t, parse(t, [""])[0]) for t in more)])
            at |= {t: len(own) + k for k, t in enumerate(more)}
            follow = signs[[at[following] for _, following in known]]
            signs, other = signs[: len(own)], signer.sign(changed)
            digests = [hashlib.sha256(t.encode()).hexdigest() for t, _ in changed]
            row = {pair: k for k, pair in enumerate(known)}
            picks = np.array([row[p[1:]] for p in pairs])
            hexed = lambda rows: pa.array([x.astype(">u2").tobytes().hex() for x in rows], pa.string()).take(pa.array(picks))
            columns = [pa.array([None if p[0] == NONE else p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()), pa.array(digests, pa.string()).take(pa.array(picks))]
            columns += [hexed(signs), hexed(other), pa.array(likeness(signs, other)[picks]), pa.array(likeness(signs, follow)[picks])]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split(" ")[0] for x in SCHEMA.split(", "))])

        pairs, weight = [], 0
        for run, guest, doc_id, text in rows():
            if held is not None and held[0] == run:
                pairs.append((held[1], held[2], text))
                weight += len(held[2]) if len(pairs) == 1 or pairs[-1][1:] != pairs[-2][1:] else 100
            held = None if guest else (run, doc_id, text)
            if weight > 1_000_000:
                yield settle(pairs)
                pairs, weight = [], 0
        if pairs:
            yield settle(pairs)

    return dealt.mapInArrow(walk, f"doc_id bigint, {SCHEMA}")
