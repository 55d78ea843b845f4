"""Quality scores from histogram gradient-boosted trees over statistics of documents.

The statistics come from whole texts. Trees are grown on a bounded sample of labelled rows (SAMPLE, a documented bound),
on quantile bins of the statistics, all of one depth, so that a forest is three flat arrays and a batch of documents
goes through all trees at once, level by level.

Defined results: null counts as empty, and an empty text has statistics zero; repeated rows get equal scores; without
labelled rows of both kinds, all scores are 0.5; only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .labelled import sample

SAMPLE, BINS, DEPTH, TREES, RATE = 20_000, 64, 4, 60, 0.15
#: Frequent short words of four languages.
COMMON = frozenset(
    "the of and to in a is that for it as was with be by on not this are or from at le la les de des du un une et en que qui dans pour sur pas est au"
    " der die das und ist von mit den im nicht ein eine zu auf für es sich el los las del y con por para una su se como".split()
)
STATISTICS = (
    "log_chars", "log_words", "mean_word", "deviation_word", "upper", "digits", "punctuation", "symbols", "white", "log_lines", "words_a_line", "short_lines", "repeated_lines",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "common", "upper_words", "ends", "entropy", "longest_word", "exclaimed", "bars",
)


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of STATISTICS."""
    words, lines = text.split(), text.split("\n")
    n, w = len(text), len(words)
    if not w:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = np.bincount(np.minimum(points, 255), minlength=256)
    share = low[low > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, w)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    per_line = [len(x.split()) for x in lines]
    upper, symbols = int(low[65:91].sum()), sum(int(low[ord(c)]) for c in "#*%&$^~<>{}[]\\=+_@")
    punctuation = sum(int(low[ord(c)]) for c in ".,;:!?'\"()-")
    return [
        math.log1p(n), math.log1p(w), float(sizes.mean()), float(sizes.std()), upper / n, int(low[48:58].sum()) / n, punctuation / n, symbols / n, int(low[32] + low[9:14].sum()) / n,
        math.log1p(len(lines)), w / len(lines), sum(k < 3 for k in per_line) / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / w, max(counts.values()) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, pairs / max(1, w - 1), sum(v for k, v in counts.items() if k.lower() in COMMON) / w,
        sum(v for k, v in counts.items() if len(k) > 1 and k.isupper()) / w, sum(x.rstrip()[-1:] in ".!?" for x in lines if x) / len(lines), float(-(share * np.log2(share)).sum()), math.log1p(int(sizes.max())),
        int(low[33]) / w, int(low[124]) / w,
    ]


@dataclass
class Forest:
    """Trees of one depth in flat arrays: inner node i of a tree has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; greater values go right
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.feature.size:
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        trees, inner = np.arange(len(self.feature))[None, :], self.feature.shape[1]
        node, rows = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(x))[:, None]
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 5.0) -> Forest:
    """Boosts trees for the logistic loss. In each level the gradients of all nodes are summed into histograms at once."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, features = x.shape
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = math.log(mean / (1 - mean))
    total, inner, leaves = np.full(n, start), 2**depth - 1, 2**depth
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            where = [(0, None)] * width
            for f in range(features):
                cell = (node - first) * bins + binned[:, f]
                sums = [np.cumsum(np.bincount(cell, v, width * bins).reshape(width, bins), axis=1) for v in (g, h, np.ones(n))]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < 5) | (nt - nl < 5)] = 0
                cut = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), cut] > best).tolist():
                    best[k], where[k] = gain[k, cut[k]], (f, int(cut[k]))
            right = np.zeros(n, np.int64)
            for k, (f, cut) in enumerate(where):
                if cut is not None and cut < len(edges[f]):
                    out.feature[t, first + k], out.threshold[t, first + k] = f, edges[f][cut]
                    own = node == first + k
                    right[own] = binned[own, f] > cut
            node = 2 * node + 1 + right
        leaf = node - inner
        out.value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        total += out.value[t][leaf]
    return out


def measured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and x array<double>, the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Forest:
    """A forest from at most `most` labelled rows that aren't held out."""
    rows = measured(sample(docs, labels, label, most), ["y"]).toPandas()  # `most` rows of some numbers
    if rows["y"].nunique() < 2:
        return Forest(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), 0.0)
    return grow(np.stack(rows["x"].to_numpy()), (rows["y"] > 0).to_numpy(float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                x = np.array([statistics(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(forest.score(x))], names=["doc_id", "score"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
