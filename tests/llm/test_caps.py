"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from pitchlake.llm import caps
from pitchlake.llm.queries import op13_spherical_caps


def brute(rows: list[tuple]) -> list[tuple]:
    """The contract's rows, from all pairs."""
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, None if None in (rows[i][0], least) else rows[i][0] == least))
    return sorted(out, key=str)


def apart(r: np.random.Generator, x: np.ndarray, cosine: float) -> np.ndarray:
    """A vector with this cosine to x."""
    u = r.standard_normal(len(x))
    u -= u @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


@pytest.mark.parametrize("group", [16, 2048])
def test_against_all_pairs(spark, tmp_path, group):
    """A dense group, pairs, a chain, equal vectors and multiples, vectors that link with nothing, other lengths, clashing columns, repeated rows."""
    r = np.random.default_rng(11)
    vectors = list(r.standard_normal((150, 64)))
    centre = r.standard_normal(64)
    vectors += [centre + 0.2 * r.standard_normal(64) for _ in range(120)]  # cosines of some 0.96
    vectors += [apart(r, vectors[k], c) for k, c in zip(range(40), np.linspace(0.93, 0.99, 40))]
    vectors += [apart(r, vectors[k], 0.85) for k in range(40, 60)]
    chain = [r.standard_normal(64)]
    for _ in range(8):
        chain.append(apart(r, chain[-1], 0.94))
    vectors += chain + [vectors[3]] * 5 + [vectors[4] * 1e30, vectors[4] * 1e-30]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [1.0, None]), (904, [1.0, nan]), (905, [inf, 1.0]), (906, [nan, inf]), (907, [2.0, 0.1]), (908, [1.0, 0.0]), (909, [3.0]), (910, [-0.0, 1.0]), (911, [0.0, 1.0]), (None, rows[7][1]), rows[8], (-5, [0.5, 0.25, 0.125]), (None, [0.5, 0.25, 0.125])]
    order = r.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(*rows[k], 1, "x") for k in order], "vec_id long, embedding array<float>, key int, data string").repartition(3)
    got = caps.near_duplicates(df, group=group).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(2, [1.0, 2.0]), (1, [1.0, 2.5]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op13_spherical_caps(spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op13_spherical_caps(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("dims", "cosine", "least"), [(64, 0.9, 0.99), (64, 0.93, 0.997), (32, 0.9, 0.99), (200, 0.9, 0.99)])
def test_recall(dims, cosine, least):
    """The share of pairs with a common filter, just at the threshold and above, and how many filters a vector passes."""
    r = np.random.default_rng(3)
    x = caps.unit(r.standard_normal((2000, dims)))
    y = caps.unit(np.array([apart(r, v, cosine) for v in x]))
    sets = []
    for m in (x, y):
        row, found = caps.passed(m)
        ends = np.searchsorted(row, np.arange(len(m) + 1))
        sets.append([set(found[a:b].tolist()) for a, b in zip(ends, ends[1:])])
    assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= least
    assert 20 < np.mean([len(s) for s in sets[0]]) < 80


def test_passed_is_what_exceeds_the_bound():
    x = caps.unit(np.random.default_rng(5).standard_normal((3, 64))).astype(np.float32)
    row, found = caps.passed(x)
    want = set()
    for t, (a, b) in enumerate(caps.codes(64)):
        p, q = x @ a, x @ b
        for i, u, v in zip(*np.nonzero(p[:, :, None] + q[:, None, :] >= np.float32(caps.BOUND / 8))):
            want.add((int(i), int((t * caps.CODE + u) * caps.CODE + v)))
    assert set(zip(row.tolist(), found.tolist())) == want
