"""Byte-level BPE: encoding by the ranks of a public vocabulary, and decoding.

Boundaries of the words to be merged are found without a regular expression: each code point gets a class, each
class is a function from automaton state to automaton state, and the states before all code points come from one
associative scan that composes these functions. The functions form a small finite monoid, so composing two of them
is one table lookup. The words between the boundaries go through pair merging, which a bounded cache spares for
words seen before.

Defined results: a null text counts as empty, and an empty text has no tokens; repeated rows give repeated results;
only the id and the text column are read, so extra columns can't clash; null ids and ties stay as they are; an empty
table gives an empty one. Text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, spread, texts, utf8

#: The suffixes that the pattern of the public tokenizer splits off after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

#: Classes of code points, and with the look at the next ones the symbols that the automaton reads: letter, number,
#: other, apostrophe before one or two suffix letters, space or other white space before a visible character, and
#: white space before white space or the end.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, INNER = range(8)
#: States before a code point: a word has ended; in letters, numbers, others, white space; after a space that joins
#: what follows; one or two suffix letters to go.
ENDED, LETTERS, NUMBERS, OTHERS, WHITE, JOIN, LAST, TWO = range(8)

#: The rank of neighbours that never merge; and up to how many bytes words merge together in rounds.
NEVER, SHORT_WORD = 1 << 40, 48
#: Bytes of text that are encoded at once, and tokens that are decoded at once; a longer document stands alone.
BYTES, TOKENS = 500_000, 100_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a word starts at this symbol."""
    fresh = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: LAST, LONG: TWO, SPACE: JOIN, BLANK: ENDED, INNER: WHITE}[symbol]
    if state in (LAST, TWO):
        return (ENDED if state == LAST else LAST), False
    visible = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: OTHERS, LONG: OTHERS}.get(symbol)
    if state == JOIN and visible is not None:
        return visible, False
    if state in (LETTERS, NUMBERS, OTHERS) and visible == state:
        return state, False
    if state == WHITE and symbol == INNER:
        return WHITE, False
    return fresh, True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions (8 plain, 8 that first forget the state), the table of products of all functions,
    their values at ENDED, and whether a word starts, by state and symbol."""
    steps = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    found = {f: i for i, f in enumerate(dict.fromkeys([*steps, *((f[ENDED],) * 8 for f in steps)]))}
    gens, todo = list(found), list(found)
    while todo:
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[q] for q in f)) not in found:
                found[h] = len(found)
                todo.append(h)
    every = np.array(list(found), np.int64)
    ids = {f: i for f, i in found.items()}
    product = np.array([[ids[tuple(every[g][every[f]].tolist())] for g in range(len(every))] for f in range(len(every))], np.uint16)
    symbols = np.array([*(ids[f] for f in steps), *(ids[(f[ENDED],) * 8] for f in steps)], np.uint16)
    return symbols, product, every[:, ENDED].astype(np.uint8), np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[[0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x20, *range(0x09, 0x0E), *range(0x2000, 0x200B)]] = BLANK
    return table


def compose_scan(functions: np.ndarray, product: np.ndarray) -> np.ndarray:
    """For each i the product of functions[0..i], by pairwise reduction and expansion: about two lookups an element."""
    if len(functions) < 2:
        return functions
    n, flat, m = len(functions), product.ravel(), product.shape[1]
    pairs = flat[functions[0 : n - 1 : 2].astype(np.int32) * m + functions[1::2]]
    upper, out = compose_scan(pairs, product), np.empty_like(functions)
    out[1::2] = upper
    out[0] = functions[0]
    out[2::2] = flat[upper[: len(functions[2::2])].astype(np.int32) * m + functions[2::2]]
    return out


def word_starts(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where words start, in texts that stand one after the other at these byte offsets."""
    if not data:
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
    first = np.zeros(len(points) + 1, bool)  # of a text
    first[np.searchsorted(byte_at, offsets)] = True
    first[-1] = True
    symbol = code_point_classes()[points]
    blank = symbol == BLANK
    visible_next = np.zeros(len(points), bool)
    visible_next[:-1] = ~blank[1:] & ~first[1:-1]
    symbol[blank & ~visible_next] = INNER
    symbol[blank & visible_next & (points == 0x20)] = SPACE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        ends = np.concatenate([first, [True]])
        inside = ~ends[quote + 1]
        symbol[quote[inside & np.isin(padded[quote + 1], [ord(c) for c in ONE_LETTER])]] = SHORT
        inside &= ~ends[np.minimum(quote + 2, len(ends) - 1)]
        pair = np.isin(padded[quote + 1].astype(np.int64) << 32 | padded[quote + 2], [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])
        symbol[quote[inside & pair]] = LONG
    ids, product, values, starts = automaton()
    states = np.empty(len(points), np.uint8)
    states[0] = ENDED
    states[1:] = values[compose_scan(ids[symbol + 8 * first[:-1].astype(np.uint8)], product)[:-1]]
    states[first[:-1]] = ENDED
    return byte_at[starts[states, symbol]]


class Vocabulary:
    """Tokens by rank, a cache of merged words, and the tokens' bytes for decoding."""

    def __init__(self, lines: bytes, most_words: int = 1 << 17) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        by_id = dict(zip(self.ranks.values(), self.ranks))
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)
        self.most_words = most_words
        self.clear()

        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted((self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pairs, self.pair_ranks = np.array([x[0] for x in pairs] + [1 << 62], np.int64), np.array([x[1] for x in pairs] + [NEVER], np.int64)

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two neighbours merge into, or NEVER."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def learn(self, fresh: list[bytes]) -> None:
        """Merges new words and puts them in the cache: short ones all at once, a merge of each in every round."""
        out: list = [self.ranks.get(w) for w in fresh]
        todo = [i for i, x in enumerate(out) if x is None and len(fresh[i]) <= SHORT_WORD]
        if todo:
            for i, x in zip(todo, self._merge_all([fresh[i] for i in todo])):
                out[i] = x
        for i, x in enumerate(out):
            if x is None:
                self.ids.extend(merge(fresh[i], self.ranks))
            elif isinstance(x, int):
                self.ids.append(x)
            else:
                self.ids.extend(x)
            self.ends.append(len(self.ids))

    def _merge_all(self, words: list[bytes]) -> list[list[int]]:
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        sizes, names, out = np.array([len(w) for w in words]), np.arange(len(words)), [[]] * len(words)
        ranks = np.full(len(symbols), NEVER)
        ranks[:-1] = self.pair_rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = NEVER
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            if (done := least == NEVER).any():
                flat, at = symbols[np.repeat(done, sizes)].tolist(), 0
                for i, n in zip(names[done].tolist(), sizes[done].tolist()):
                    out[i] = flat[at : at + n]
                    at += n
                stay = np.repeat(~done, sizes)
                symbols, ranks, sizes, names, least = symbols[stay], ranks[stay], sizes[~done], names[~done], least[~done]
                if not len(sizes):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == least[owner])
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]  # the leftmost of each word
            symbols[at] = least
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner, symbols, ranks = owner[keep], symbols[keep], ranks[keep]
            sizes = sizes - 1
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                ranks[left] = np.where((owner[left] == owner[right]) & (right > left), self.pair_rank(symbols[left], symbols[right]), NEVER)
        return out

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand one after the other at these byte offsets; and the offsets of the texts in the ids."""
        starts = word_starts(data, offsets)
        if len(self.words) > self.most_words:
            self.clear()
        at = starts.tolist()
        words, known = self.words, self.words.get
        fresh, picks = [], []
        for a, b in zip(at, [*at[1:], len(data)]):
            if (n := known(piece := data[a:b])) is None:
                n = words[piece] = len(words)
                fresh.append(piece)
            picks.append(n)
        self.learn(fresh)
        ids, ends = spread(np.array(self.ids, np.int32), np.array(self.ends, np.int64), np.array(picks, np.int64))
        return ids, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all tokens, and the offsets of the tokens in them."""
        flat, ends = spread(self.bytes, self.at, ids)
        return flat.tobytes(), ends


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the neighbours with the least rank merge, leftmost first, until none can."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    after, before, end, gone = [*range(1, n), -1], [-1, *range(n - 1)], [*range(1, n + 1)], n + 1
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] == gone or j < 0 or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], gone
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


_LOADED: dict[str, Vocabulary] = {}


def loaded(path: str, lines: Broadcast) -> Vocabulary:
    """One vocabulary for each Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Vocabulary(lines.value)
    return _LOADED[path]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file for all executors; a file over 64 MB is refused, so the broadcast is bounded."""
    with open(path, "rb") as f:
        lines = f.read((64 << 20) + 1)
    if len(lines) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary file: it has over 64 MB")
    return spark.sparkContext.broadcast(lines)


def ragged(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, kind))


def _encoded(words: Vocabulary, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the texts of a batch, the offsets of the texts in them, and the byte of its text at which each token starts."""
    data, at = utf8(batch.column("text"))
    ids, ends = words.encode(data, at)
    token_at = np.concatenate([[0], np.cumsum(words.at[ids + 1] - words.at[ids])])[:-1]
    return ids, ends, (token_at - np.repeat(at[:-1], np.diff(ends))).astype(np.int32)


def _decoded(words: Vocabulary, ids: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of some rows of ids; offsets that don't fit the ids are an error."""
    data, token_at = words.decode(ids)
    at = token_at[ends]
    if not np.array_equal(offsets, token_at[:-1] - np.repeat(at[:-1], np.diff(ends))):
        raise ValueError("the offsets don't belong to these ids and this vocabulary")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> and offsets array<int> (the byte where each token starts) for each row of docs."""
    lines = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path, lines)
        for batch in pieces(batches, most=BYTES):
            ids, ends, offsets = _encoded(words, batch)
            columns = [batch.column("doc_id"), ragged(ids, ends, pa.int32()), ragged(offsets, ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, f"doc_id {_kind(slim)}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids and text (binary, UTF-8) for each row of ids and offsets; offsets that don't fit the ids are an error."""
    lines = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path, lines)
        for whole in batches:
            part = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(whole.column("ids")), 0), dtype=np.int64)) // TOKENS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(whole)] if len(whole) else [0]
            for a, b in zip(edges, edges[1:]):
                batch = whole.slice(a, b - a)
                ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids), dtype=np.int64))])
                flat, offsets = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, batch.column("offsets")))
                text = _decoded(words, flat.astype(np.int64), ends, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], names=["doc_id", "ids", "text"])

    slim = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), "ids", "offsets")
    return slim.mapInArrow(run, f"doc_id {_kind(slim)}, ids array<int>, text binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode() makes of encode(), piece by piece in one pass, so that the offsets stay where they are made."""
    lines = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path, lines)
        for batch in pieces(batches, most=BYTES):
            ids, ends, offsets = _encoded(words, batch)
            text = _decoded(words, ids.astype(np.int64), ends, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ragged(ids, ends, pa.int32()), text], names=["doc_id", "ids", "text"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, f"doc_id {_kind(slim)}, ids array<int>, text binary")
