"""The most similar rows within groups, by blocks of vectors that meet as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; pairs that are held at once; rows of which the greatest cosine is taken; pairs to score for each that is kept, at most.
BLOCK, HELD, PART, FEW = 8000, 2_000_000, 16, 8


def _likeness(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Ten-thousandths of the likeness of all rows of x with all of y; mx, my: 1 where measured. Sums go over what both have."""
    shared = mx @ my.T
    norm = np.sqrt((x * x) @ my.T) * np.sqrt(mx @ (y * y).T)
    cosine = np.divide(x @ y.T, norm, out=np.ones_like(norm), where=norm != 0)
    return np.where(shared == 0, 0, _rounded(cosine))


def _rounded(cosine: np.ndarray) -> np.ndarray:
    """Ten-thousandths of a likeness, rounded as jsround() does, half up on the binary product."""
    return np.floor(np.clip((cosine + 1) / 2, 0, 1) * 10_000 + 0.5).astype(np.int64)


def _best(x, mx, own, y, my, other, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, ten-thousandths): the best of y for each row of x, ties by the order of y; not those with the same number (own, other).

    Where all rows measure the same, few pairs are scored: those whose cosine in single precision can be among the best.
    """
    found = ([], [], [])
    alike = bool(mx[0].any()) and bool((mx == mx[0]).all()) and bool((my == mx[0]).all())
    ux, uy = (_unit(x), _unit(y)) if alike else (None, None)
    rows = max(1, HELD // len(y))
    for k in range(0, len(x), rows):
        part = slice(k, k + rows)
        few = _candidates(ux[part], own[part], uy, other, limit) if alike else None
        row, col, score = _all(x[part], mx[part], own[part], y, my, other, limit) if few is None else _few(x[part], y, *few, limit)
        for f, v in zip(found, (row + k, col, score)):
            f.append(v)
    return tuple(np.concatenate(f) for f in found)


def _all(x, mx, own, y, my, other, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_best() of some rows, from the scores of all pairs."""
    most = min(limit, len(y))
    score = _likeness(x, mx, y, my)
    same = own[:, None] == other[None, :]
    key = np.where(same, np.iinfo(np.int64).max, (10_000 - score) * len(y) + np.arange(len(y)))
    best = np.argpartition(key, most - 1, axis=1)[:, :most] if most < len(y) else np.broadcast_to(np.arange(len(y)), key.shape)
    ok = ~np.take_along_axis(same, best, axis=1)
    return np.nonzero(ok)[0], best[ok], np.take_along_axis(score, best, axis=1)[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, zeros as they are."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm != 0).astype(np.float32)


def _candidates(ux, own, uy, other, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, row): pairs that hold the best `limit` of each row of ux by rounded likeness, and few others; None if they aren't few.

    Columns are taken together in parts of which each has its greatest cosine: `limit` of a row's cosines are at least the
    `limit`-th greatest of these. What is rounded to the same likeness differs by 2e-4 at most, single precision by far less.
    """
    cosine = ux @ uy.T
    cosine[~ux.any(axis=1)] = 1
    cosine[:, ~uy.any(axis=1)] = 1
    if np.intersect1d(own, other).size:
        cosine[own[:, None] == other[None, :]] = -2
    parts = len(uy) // PART
    if parts <= limit:
        return None
    greatest = cosine[:, : parts * PART].reshape(len(ux), PART, parts).max(axis=1)
    least = np.partition(greatest, parts - limit, axis=1)[:, parts - limit, None] - np.float32(3e-4)
    at = np.flatnonzero(cosine >= np.maximum(least, -1.5))
    return None if len(at) > FEW * limit * len(ux) else np.divmod(at, len(uy))


def _few(x, y, row, col, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_best() of some rows, from the scores of the pairs (row, col) alone."""
    norm = np.sqrt((x * x).sum(axis=1))[row] * np.sqrt((y * y).sum(axis=1))[col]
    cosine = np.divide(np.einsum("ij,ij->i", x[row], y[col]), norm, out=np.ones_like(norm), where=norm != 0)
    score = _rounded(cosine)
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, row)
    ok = np.arange(len(row)) - first < limit
    return row[ok], col[ok], score[ok]


def best_matches(dense: DataFrame, by: list[str], id_col: str, weights: list[float], limit: int, block: int = BLOCK) -> DataFrame:
    """(by, id, other, similarity): candidates for the `limit` most similar rows of the same group, `limit` of each block at most.

    dense: by, id and v (array of percentiles; null: not measured). A group of n rows is cut into n / block blocks by a hash
    of the id. Each pair of blocks is a group of its own that one task turns into matrices, both ways at once; so a row is
    sent as often as its group has blocks, pairs are never rows, and a task holds two blocks. Rows without a group are left out.
    """
    dense = dense.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, id_col]))
    sizes = dense.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    own = dense.join(sizes, by).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*by, id_col, "v", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    root = np.sqrt(np.array(weights, float))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        codes = table.column(id_col).combine_chunks().dictionary_encode().indices.to_numpy()
        v = table.column("v").combine_chunks()
        flat = v.flatten()
        measured = np.asarray(flat.is_valid()).reshape(len(v), -1)
        x = np.where(measured, (np.asarray(flat.fill_null(50.0)).reshape(len(v), -1) - 50.0) * root, 0.0)
        m, block_of = measured.astype(float), table.column("_own").to_numpy()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        sides = [(np.flatnonzero(block_of == a), np.flatnonzero(block_of == b)) for a, b in dict.fromkeys([(i, j), (j, i)])]
        subject, other, score = [], [], []
        for a, b in sides:
            if len(a) and len(b):
                p, q, s = _best(x[a], m[a], codes[a], x[b], m[b], codes[b], limit)
                subject.append(a[p])
                other.append(b[q])
                score.append(s)
        at = np.concatenate(subject) if subject else np.zeros(0, np.int64)
        with_ = np.concatenate(other) if other else at
        ids = table.column(id_col)
        columns = [table.column(c).take(pa.array(at)) for c in by]
        found = np.concatenate(score) if score else at
        return pa.table([*columns, ids.take(pa.array(at)), ids.take(pa.array(with_)), pa.array(found / 10_000.0)], names=[*by, id_col, "other", "similarity"])

    kinds = {f.name: f.dataType.simpleString() for f in dense.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, id_col]), f"other {kinds[id_col]}", "similarity double"])
    return dealt.groupBy(*by, "_i", "_j").applyInArrow(meet, schema)
