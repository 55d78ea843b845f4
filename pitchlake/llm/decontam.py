"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each row is a segment that holds the postings of all words of some consecutive
documents (about SEGMENT words; a longer document is a segment of its own). A word's list has its positions in
ascending order; documents are one position apart, so that no phrase reaches over two. A query goes to every segment:
its words' lists are intersected from the rarest in the segment on, each shifted by the word's offset, until none is
left or all have agreed. Nothing is shuffled, a hot word's list is never longer than a segment, and the index is a table
in the shared folder, so a lost executor costs only the segments that it was reading.

The items are a stated query set. They go to the segments in blocks of about BLOCK bytes of text, one after the other: the
driver passes on one block's packed words and numbers at a time (less than twice its text), a Python worker holds about
30 bytes for each byte of it at worst. A segment looks its own words up among the block's; only windows of which it has
every word and every pair of neighbours are searched, all in one step, from the rarest pair on.

Defined results: a null or empty text has no words, is never hit, and as an item has no window; repeated rows of
documents get equal results, and rows of one id are told apart by tie, the hash of their text; null ids stay null;
repeated items count once; a null item id is the item "null"; extra columns are not read; an empty index gives an empty
table. Texts are indexed whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_path, stored, texts, utf8

#: Words of a window, words of a segment, bytes of a block of items, postings that are held against windows at once.
WINDOW, SEGMENT, BLOCK, AT_ONCE = 13, 200_000, 4 << 20, 1 << 20
#: A-Z become lower case; what is no digit, letter or byte of a longer character separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "segment string, docs binary, ties binary, sizes binary, terms binary, counts binary, positions binary"
NONE = -(1 << 63)
NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def unpacked(x: bytes, kind: type | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The segments: ids, ties and numbers of words of their documents, their words, and by word the count and the
    positions (differences within a list), all compressed, and a hash of the documents. Ids are 64-bit integers."""

    def segment_of(docs: list[tuple[int, int]], words: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        terms = np.fromiter((known.setdefault(w, len(known)) for doc in words for w in doc), np.int32, int(sizes.sum()))
        at = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(known)).astype(np.int32)
        steps = np.diff(at[order], prepend=0)
        if len(counts):
            first = np.cumsum(counts) - counts
            steps[first] = at[order][first]
        ids, ties = np.array(docs, np.int64).reshape(-1, 2).T
        row = [packed(x) for x in (ids, ties, sizes, b" ".join(known), counts, steps.astype(np.int32))]
        name = hashlib.md5(ids.tobytes() + ties.tobytes()).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in row)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, n = [], [], 0
        for batch in pieces(batches):
            data, at = utf8(batch.column("text"))
            ids = batch.column("doc_id").fill_null(NONE).to_pylist()
            for key, a, b in zip(zip(ids, batch.column("tie").to_pylist()), at[:-1].tolist(), at[1:].tolist()):
                own = words_of(data[a:b])
                if n and n + len(own) > segment:
                    yield segment_of(docs, words)
                    docs, words, n = [], [], 0
                docs.append(key)
                words.append(own)
                n += len(own)
        if docs:
            yield segment_of(docs, words)

    slim = texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return slim.mapInArrow(run, INDEX)


class Segment:
    """A segment's lists, by word."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.name, self.docs, self.sizes = row["segment"], unpacked(row["docs"], np.int64), unpacked(row["sizes"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1  # position of each document's first word
        terms = unpacked(row["terms"])
        self.terms = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.counts, self.steps = unpacked(row["counts"], np.int32), unpacked(row["positions"], np.int32)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.lists: dict[int, np.ndarray] = {}
        self._pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers by position (-1 between documents), and the postings of all pairs of neighbours: their codes in
        order, and the positions."""
        if self._pairs is None:
            at = np.full(int((self.sizes + 1).sum()) + 1, -1, np.int64)
            at[self.places()] = np.repeat(np.arange(len(self.counts)), self.counts)
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            codes = at[both] * len(self.counts) + at[both + 1]
            order = np.argsort(codes, kind="stable")
            self._pairs = at, codes[order], both[order]
        return self._pairs

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = np.cumsum(self.steps[self.starts[term] : self.starts[term] + self.counts[term]], dtype=np.int64)
        return self.lists[term]

    def places(self) -> np.ndarray:
        """The positions of all words, list after list."""
        ends = np.cumsum(self.steps, dtype=np.int64)
        return ends - np.repeat(ends[self.starts] - self.steps[self.starts], self.counts) if len(ends) else ends

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Positions where the words of a phrase follow each other."""
        found = None
        for k in sorted(range(len(terms)), key=lambda k: self.counts[terms[k]]):
            own = self.positions(terms[k])
            if found is None:
                found = own - k
                continue
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest of some words that have all others at most slop words away in the same document."""
        order = sorted(terms, key=lambda t: self.counts[t])
        found = self.positions(order[0])
        doc = lambda p: np.searchsorted(self.first, p, side="right")
        for t in order[1:]:
            own = np.concatenate([[-(1 << 40)], self.positions(t), [1 << 40]])
            at = np.searchsorted(own, found)
            keep = np.zeros(len(found), bool)
            for other in (own[at - 1], own[at]):
                keep |= (abs(other - found) <= slop) & (doc(other) == doc(found))
            found = found[keep]
        return found


def searched(index: DataFrame, found: str, search) -> DataFrame:
    """search(segment) -> a record batch, for every segment of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield search(Segment({c: batch.column(c)[k].as_py() for c in NAMES}))

    return index.mapInArrow(run, found)


def phrase_matches(index: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, doc_id, position): where whole phrases occur, in words from the start of a document."""
    return _matches(index, phrases, lambda s, terms: s.phrase(terms))


def proximity_matches(index: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """(phrase, doc_id, position): the rarest word's place where all words of a phrase are at most slop words from it."""
    return _matches(index, phrases, lambda s, terms: s.near(terms, slop))


def _matches(index: DataFrame, phrases: list[str], of) -> DataFrame:
    asked = [(p, words_of(p.encode())) for p in phrases]

    def search(s: Segment) -> pa.RecordBatch:
        rows = []
        for p, words in asked:
            if words and all(w in s.terms for w in words):
                for at in of(s, [s.terms[w] for w in words]).tolist():
                    d = int(np.searchsorted(s.first, at, side="right")) - 1
                    rows.append((p, int(s.docs[d]), at - int(s.first[d])))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["phrase", "doc_id", "position"])

    return searched(index, "phrase string, doc_id bigint, position bigint", search)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, data): the distinct items with words in blocks of about `block` bytes, each packed into one value."""
    own = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))

    def pack(number: int, rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        words = [words_of(text) for _, text in rows]
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        tokens = np.fromiter((known.setdefault(w, len(known)) for x in words for w in x), np.int32, int(sizes.sum()))
        names = json.dumps([item for item, _ in rows]).encode()
        parts = [packed(x) for x in (names, sizes, b" ".join(known), tokens)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], names=["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for number, item, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item", "text"))):
                if rows and number != now:
                    yield pack(now, rows)
                    rows = []
                now = number
                rows.append((item, text.encode()))
        if rows:
            yield pack(now, rows)

    return dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, "block int, data array<binary>")


class Items:
    """A block's items: their words as numbers, and their windows as stretches of them."""

    def __init__(self, data: list[bytes], window: int) -> None:
        names, sizes, terms, self.tokens = unpacked(data[0]), unpacked(data[1], np.int32), unpacked(data[2]), unpacked(data[3], np.int32)
        self.terms = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.names = json.loads(names)
        n_windows = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0).astype(np.int64)
        self.item = np.repeat(np.arange(len(sizes)), n_windows)  # of each window
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first[self.item]
        self.end = self.start + np.minimum(sizes, window)[self.item]
        self.same = np.arange(len(self.item))  # of equal windows the one that stands for all, where they have been searched

    def found_in(self, s: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, position, length) of all occurrences of windows in a segment; of equal windows one stands for all.

        A window occurs only if all its pairs of neighbours do. Those that are left are searched all at once: the postings of
        each one's rarest pair, shifted by its place in the window, are held against its other words, the rarest first.
        """
        get = self.terms.get
        own = np.array([get(t, -1) for t in s.terms], np.int64)
        there = np.full(len(self.terms) + 1, -1, np.int64)
        there[own[own >= 0]] = np.flatnonzero(own >= 0)
        at, codes, places = s.pairs()
        tokens, n_terms = there[self.tokens], len(s.counts)
        code = np.where((tokens[:-1] >= 0) & (tokens[1:] >= 0), tokens[:-1] * n_terms + tokens[1:], -1)
        low, high = (np.searchsorted(codes, code, side=side) for side in ("left", "right"))
        missing = np.concatenate([[0], np.cumsum(high == low)])  # pairs, also those that two items share
        absent = np.concatenate([[0], np.cumsum(tokens < 0)])
        alive = np.flatnonzero((absent[self.end] == absent[self.start]) & (missing[self.end - 1] == missing[self.start]))
        found: tuple[list, list, list] = ([], [], [])
        size = (self.end - self.start)[alive]
        for n in np.unique(size).tolist():
            windows = alive[size == n]
            words = tokens[self.start[windows][:, None] + np.arange(n)]
            _, first, back = np.unique(words, axis=0, return_index=True, return_inverse=True)
            self.same[windows] = windows[first][back.reshape(-1)]
            windows, words = windows[first], words[first]
            if n == 1:
                count, start, shift = s.counts[words[:, 0]].astype(np.int64), s.starts[words[:, 0]], np.zeros(len(windows), np.int64)
                postings = s.places()
            else:
                pair = self.start[windows][:, None] + np.arange(n - 1)
                shift = np.argmin(high[pair] - low[pair], axis=1)
                rarest = pair[np.arange(len(pair)), shift]
                count, start, postings = high[rarest] - low[rarest], low[rarest], places
            order = np.argsort(s.counts[words], axis=1)
            part = np.cumsum(count) // AT_ONCE
            for k in np.unique(part).tolist():
                own = np.flatnonzero(part == k)
                of = np.repeat(own, count[own])
                p = postings[np.arange(len(of)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + start[of]] - shift[of]
                keep = (p >= 0) & (p + n < len(at))
                of, p = of[keep], p[keep]
                for rank in range(n):
                    o = order[of, rank]
                    keep = at[p + o] == words[of, o]
                    of, p = of[keep], p[keep]
                for x, y in zip(found, (windows[of], p, np.full(len(of), n, np.int64))):
                    x.append(y)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)

    def items_of(self, windows: np.ndarray, docs: np.ndarray) -> dict[int, set[int]]:
        """For each document the items of the windows that occur in it, of which found_in() has named one of those that are equal."""
        own = np.unique(np.stack([windows, docs]), axis=1)
        order = np.argsort(self.same, kind="stable")
        low, high = (np.searchsorted(self.same[order], own[0], side=side) for side in ("left", "right"))
        out: dict[int, set[int]] = defaultdict(set)
        for doc, a, b in zip(own[1].tolist(), low.tolist(), high.tolist()):
            out[doc].update(self.item[order[a:b]].tolist())
        return out


HITS = "segment string, no int, hit array<int>, items array<string>"


def contamination(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """For each document of an index: doc_id, tie, n_words, n_hit (words inside an occurrence of a window) and items
    array<string> (those with occurring windows, distinct, sorted)."""
    spark, path = items.sparkSession, shared_path(items.sparkSession, "hits")
    blocks = stored(item_blocks(items, id_col, text_col, block), "items")
    spark.createDataFrame([], HITS).write.parquet(f"{path}/none")
    for number in [r["block"] for r in blocks.select("block").collect()]:  # a number for each block
        data = spark.sparkContext.broadcast([bytes(x) for x in blocks.where(F.col("block") == number).first()["data"]])
        searched(index, HITS, _windows_in(data, window)).write.parquet(f"{path}/{number}")
        data.destroy()
    hits = spark.read.schema(HITS).option("recursiveFileLookup", True).parquet(path)
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  of one array for each block
    gathered = hits.groupBy("segment", "no").agg(F.size(union("hit")).cast("long").alias("n_hit"), F.array_sort(union("items")).alias("items"))
    none = F.array().cast("array<string>")
    return documents(index).join(gathered, ["segment", "no"], "left").select(
        "doc_id", "tie", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def documents(index: DataFrame) -> DataFrame:
    """(segment, no, doc_id, tie, n_words) for each document of an index; its postings aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("segment", "docs", "ties", "sizes"))):
                ids, ties, sizes = (unpacked(x, t) for x, t in zip(row, (np.int64, np.int64, np.int32)))
                columns = [pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=ids == NONE), pa.array(ties)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int64))], names=["segment", "no", "doc_id", "tie", "n_words"])

    return index.select("segment", "docs", "ties", "sizes").mapInArrow(run, "segment string, no int, doc_id bigint, tie bigint, n_words bigint")


def _windows_in(data, window: int):
    """search() for the documents that windows of a broadcast block hit."""
    known: list[Items] = []  # once in a task

    def search(s: Segment) -> pa.RecordBatch:
        if not known:
            known.append(Items(data.value, window))
        edges = np.zeros(int((s.sizes + 1).sum()) + 1, np.int64)
        windows, found, size = known[0].found_in(s)
        np.add.at(edges, found, 1)
        np.add.at(edges, found + size, -1)
        items = known[0].items_of(windows, np.searchsorted(s.first, found, side="right") - 1)
        hit = np.flatnonzero(np.cumsum(edges) > 0)
        of = np.searchsorted(s.first, hit, side="right") - 1
        docs = sorted(items)
        ends = np.concatenate([[0], np.searchsorted(of, docs, side="right")]).astype(np.int32) if docs else np.zeros(1, np.int32)
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array((hit - s.first[of]).astype(np.int32)))
        names = pa.array([sorted({known[0].names[i] for i in items[d]}) for d in docs], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([s.name] * len(docs), pa.string()), pa.array(docs, pa.int32()), places, names], names=["segment", "no", "hit", "items"])

    return search


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination() of documents (doc_id, text) by items (item_id, text), over an index in the shared folder."""
    return contamination(stored(build_index(docs), "index"), items)


#: DuckDB SQL of the registered query.
ORACLE = rf"""
WITH low(kind, id, text) AS (
  SELECT 'd', CAST(doc_id AS VARCHAR), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
  UNION ALL
  SELECT 'i', CAST(item_id AS VARCHAR), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
starts AS (SELECT id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(2, len(w) - {WINDOW} + 2))) AS p FROM words WHERE kind = 'i' AND len(w) > 0),
windows AS (SELECT DISTINCT id, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, lengths WHERE kind = 'd' AND len(w) >= n),
found AS (SELECT p.id, p.p, p.n, w.id AS item FROM places p JOIN windows w ON w.n = p.n AND w.gram = array_to_string(p.w[p.p:p.p + p.n - 1], ' ')),
hit AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS place FROM found) GROUP BY id),
items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY id)
SELECT CAST(d.id AS BIGINT) AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words d LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""
