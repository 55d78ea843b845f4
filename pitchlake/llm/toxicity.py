"""Toxicity scores from a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lowers case, gives look-alike letters of other scripts and digits that stand for letters one form, drops marks
that compose with no letter and invisible characters inside words, and makes the rest spaces. A lexicon entry is a word
or the beginning of a word; at each word the longest entry counts, unless the word lies in an exception phrase. The sum of
the weights, divided by the number of words, goes through a logistic curve to a score between 0 and 1.

Entries, exception phrases, weights and the curve come from at most SAMPLE labelled rows (a documented bound). An entry
must stand in toxic texts significantly more often than in others, and its weight is the logarithm of that ratio. An
exception phrase is a word at which an entry matches, with the word before or after it, that stands in several clean
texts and in no toxic one.

Defined results: null counts as empty, and an empty text gets the curve's value for no matches; repeated rows get equal
scores, and count once in a fit; without any labelled row, all scores are 0.0; only id and text are read, so extra columns
can't clash; rows without an id are scored like others; an empty table gives an empty one. Texts are matched whole.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .labelled import sample

#: Labelled rows, entries and exception phrases at most; clean texts that an exception phrase needs.
SAMPLE, ENTRIES, PHRASES, CLEAN = 6000, 2000, 2000, 3
#: Strings that a task counts before it hands its counts on.
HELD = 50_000
#: Letters of other scripts, signs and digits, and the Latin letters that they are used for.
LOOKS = dict(zip("аеорсухіјѕһԁԛԝкмнтвгαορντικυεη" "0134572689" "@$", "aeopcyxijshdqwkmhtbraopvtikuen" "oieastzgbg" "as"))


@lru_cache(1)
def folds() -> np.ndarray:
    """What each code point becomes: a letter, a space, or 0 if it is dropped."""
    table = np.full(sys.maxunicode + 1, 0x20, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
        elif kind[0] == "M" or kind == "Cf":
            table[i] = 0
    for c, d in LOOKS.items():
        for x in (c, c.upper()):
            if len(x) == 1:
                table[ord(x)] = ord(d)
    for c in "lL":
        table[ord(c)] = ord("i")  # 1, l and I look alike
    table[0xFF21:0xFF3B] = table[0xFF41:0xFF5B] = table[0x61:0x7B]  # full width
    return table


def fold(text: str) -> tuple[str, int]:
    """The folded text between single spaces, and its number of words."""
    points = folds()[np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le"), np.uint32)]
    points = np.concatenate([[0x20], points[points > 0], [0x20]]).astype(np.uint32)
    letters = points != 0x20
    first = letters[1:] & ~letters[:-1]
    return points[np.concatenate([[True], letters[1:] | letters[:-1]])].tobytes().decode("utf-32-le"), int(first.sum())


def candidates(folded: str) -> set[str]:
    """Words, and beginnings of words of 4 to 8 letters; each after a space, whole words also before one."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(8, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    """Weights of the entries, exception phrases (folded), and the curve over (density, log of the sum)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            out.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            folded = fold(phrase)[0]
            out.add_word(folded, (len(folded), None))
        if len(out):
            out.make_automaton()
        return out

    def matches(self, found: ahocorasick.Automaton, folded: str) -> tuple[dict[int, tuple[int, float]], list[tuple[int, int]]]:
        """The longest entry (its length and weight) by the place before each word, and the stretches of exception phrases."""
        longest: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, w) in found.iter(folded) if len(found) else ():
            start = end - size + 1
            if w is None:
                safe.append((start, end))
            elif size > longest.get(start, (0, 0.0))[0]:
                longest[start] = (size, w)
        return longest, safe

    def features(self, found: ahocorasick.Automaton, text: str) -> tuple[float, float]:
        """Weight of the matches for each word of a text, and the logarithm of their sum."""
        folded, n = fold(text)
        longest, safe = self.matches(found, folded)
        if safe:
            inside = np.zeros(len(folded) + 1, np.int32)
            for a, b in safe:
                inside[a] += 1
                inside[b] -= 1
            inside = np.cumsum(inside)
            longest = {a: x for a, x in longest.items() if not inside[a]}
        total = sum(w for _, (_, w) in sorted(longest.items()))
        return total / (n + 20), math.log1p(total)

    def phrases(self, found: ahocorasick.Automaton, text: str) -> set[str]:
        """Words at which an entry matches, with the word before and with the word after."""
        folded, out = fold(text)[0], set()
        for at in self.matches(found, folded)[0]:
            end = folded.index(" ", at + 1)
            if before := folded[:at].rpartition(" ")[2]:
                out.add(f"{before}{folded[at:end]}")
            if after := folded[end + 1 :].partition(" ")[0] if end + 1 < len(folded) else "":
                out.add(f"{folded[at + 1 : end]} {after}")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not math.isfinite(self.curve[0]):
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


def counted(rows: DataFrame, of) -> DataFrame:
    """(entry, pos, neg): in how many texts of either label each string of of()(text) stands; of() is called once a task."""

    def part(by: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(by[0].keys() | by[1].keys())
        numbers = [pa.array([by[k][x] for x in keys], pa.int64()) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *numbers], names=["entry", "pos", "neg"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, strings = (Counter(), Counter()), of()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                by[y > 0].update(strings(text))
                if len(by[0]) + len(by[1]) > HELD:  # partial sums meet in the shuffle
                    yield part(by)
                    by = (Counter(), Counter())
        yield part(by)

    by_task = rows.mapInArrow(count, "entry string, pos bigint, neg bigint")
    return by_task.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most `most` labelled rows that aren't held out; exceptions: phrases besides those that are learned."""
    rows = sample(docs, labels, label, most)
    total = rows.agg(F.coalesce(F.sum(F.col("y").cast("boolean").cast("int")), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    p, n = total["p"], total["n"] - total["p"]
    if not p or not n:
        return Lexicon(exceptions=exceptions)
    a, b = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(a / (p + 1)) - F.log(b / (n + 1))
    known = counted(rows, lambda: lambda text: candidates(fold(text)[0])).where("pos >= 3")
    ranked = known.withColumn("w", ratio).withColumn("low", ratio - 2.58 * F.sqrt(1 / a + 1 / b))
    best = ranked.where("low > 1").orderBy(F.desc("low"), "entry").limit(ENTRIES).collect()
    out = Lexicon({r["entry"]: r["w"] for r in best}, exceptions)

    def phrases_of():
        found = out.automaton()
        return lambda text: out.phrases(found, text)

    harmless = counted(rows, phrases_of).where((F.col("pos") == 0) & (F.col("neg") >= CLEAN))
    learned = [r["entry"] for r in harmless.orderBy(F.desc("neg"), "entry").limit(PHRASES).collect()]
    out = Lexicon(out.weights, (*exceptions, *learned))
    measured = _measured(rows, out, ["y"]).collect()  # `most` rows of three numbers
    x, y = np.array([[r["density"], r["strength"]] for r in measured]), np.array([r["y"] > 0 for r in measured], float)
    out.curve = logistic(x, y)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta)), gradient)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def _measured(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The kept columns, density and strength of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon.automaton()
        for batch in batches:
            x = np.array([lexicon.features(found, t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*keep, "density", "strength"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, density double, strength double")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""
    measured = _measured(texts(docs, id_col, text_col), lexicon, ["doc_id"])
    if not math.isfinite(lexicon.curve[0]):
        return measured.select("doc_id", F.lit(0.0).alias("score"))
    a, b, c = lexicon.curve
    return measured.select("doc_id", (1 / (1 + F.exp(-(F.lit(a) + F.col("density") * b + F.col("strength") * c)))).alias("score"))
