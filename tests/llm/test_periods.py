"""Runs of periodic words against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchlake.llm import periods
from pitchlake.llm.queries import op11_block_convolution


def brute(w: list) -> list[tuple[int, int, int]]:
    """All runs, period by period; a stretch that a smaller period has already explained isn't one."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id: int, text: str | None) -> tuple:
    """The contract's row for one document."""
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


words = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.builds(lambda parts: [x for p, k in parts for x in p * k], st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=5)),
)


@settings(max_examples=400, deadline=None)
@given(words)
def test_runs_of_small_sequences(x):
    assert periods.periodic_runs(np.array(x, np.int64)) == brute(x)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_longer_sequences(seed):
    r = random.Random(seed)
    x: list[int] = []
    while len(x) < 700:
        root = [r.randrange(r.choice((2, 5, 100_000))) for _ in range(r.choice((1, 2, 3, 7, 16, 33, 64)))]
        x += (root * r.randrange(2, 9))[: r.randrange(1, 300)]
    assert periods.periodic_runs(np.array(x, np.int64)) == brute(x)


def test_transform_is_exact():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 10, (64, 3)), r.integers(0, 1 << 10, (64, 3))
    product = periods.transform(periods.transform(a.astype(np.uint64)) * periods.transform(b.astype(np.uint64)) % np.uint64(periods.PRIME), inverse=True)
    for k in range(3):
        want = [sum(int(a[i, k]) * int(b[(j - i) % 64, k]) for i in range(64)) for j in range(64)]
        assert product[:, k].tolist() == want


@pytest.mark.parametrize("n", [2**17])
def test_hard_sequences_in_bounded_time(n):
    """One word, two words by turns of all lengths, a Fibonacci word, and a long period: no scale compares all pairs."""
    fibonacci = [0]
    other = [0, 1]
    while len(other) < n:
        fibonacci, other = other, other + fibonacci
    root = np.random.default_rng(2).integers(0, 1 << 20, n // 5)
    for x in (np.zeros(n, np.int64), np.arange(n) % 7, np.array(other[:n]), np.tile(root, 5), np.random.default_rng(3).integers(0, 2, n)):
        began = time.time()
        periods.periodic_runs(np.asarray(x, np.int64))
        assert time.time() - began < 60
    assert periods.periodic_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periods.periodic_runs(np.tile(root, 5)) == [(0, len(root) * 5, len(root))]


def test_rows(spark, tmp_path):
    """Null, empty and long texts, repeated rows and ids, no id, a column that clashes, other white space, an empty table."""
    r = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "x y x y " * 4, "A a " * 4, "w\x0bv\x0cu\r" * 9]
    texts += [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 90))) for _ in range(200)]
    texts += [" ".join(["p q r s t"] * 3000)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(9, texts[9], "en")] * 2
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    out = op11_block_convolution(spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(x) for x in out.collect())
    short = {i: expected(i, t) for i, t in enumerate(texts[:-1])}
    last = len(texts) - 1
    assert [g for g in got if g[0] != last] == sorted([*short.values(), short[9], short[9]])
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and short[i][1] for i in short)
    assert [g[1:6] for g in got if g[0] == last] == [(1, 0, 15000, 5, 3_000_000)]
    nameless = periods.runs(spark.createDataFrame([(None, "b " * 8)], "doc_id long, text string")).collect()
    assert nameless[0]["doc_id"] is None and nameless[0]["collapsed"] == "b"
    assert periods.with_planted_periods(spark.createDataFrame([(None, "b  c")], "doc_id long, text string")).first()["text"] == "b  c"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/none/documents.parquet")
    assert op11_block_convolution(spark, f"{folder}/none").count() == 0
