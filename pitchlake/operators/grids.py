"""Densities on grids: points are summed to dense grids within tasks, and only these are moved."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subjects of which a task holds grids before it passes them on, points that meet all cells at once.
HELD, POINTS = 1000, 4096


def _codes(batch: pa.RecordBatch, subject: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each subject of a batch, and each row's subject as a number of these; nulls are a value of their own."""
    code = np.zeros(len(batch), np.int64)
    for c in subject:
        coded = batch.column(c).dictionary_encode()
        own = np.asarray(coded.indices.fill_null(-1)).astype(np.int64) + 1
        code = np.unique(code * (len(coded.dictionary) + 1) + own, return_inverse=True)[1].reshape(-1)
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    return first, back.reshape(-1)


def _schema(points: DataFrame, subject: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in subject), "grid array<double>"])


def density(points: DataFrame, subject: list[str], xs: list[float], ys: list[float], width: float, height: float, bandwidth: float, reach: float | None = None, kernel: bool = False) -> DataFrame:
    """(subject, col, row, value, count, weight, peak, sample_size, total_weight): the sum of Gaussian kernels of weighted points
    (x, y, weight) at all cells' centres (xs, ys), the number and weight of the points that lie in each cell of a field of width
    and height, and of each subject the largest value and the number and weight of all its points.

    reach: kernels are zero beyond this distance. kernel: points have a column k of the inverse covariance (xx, xy, yy); else
    kernels are round. A task adds its points up in a grid for each subject; a row for each subject and task is shuffled,
    and rows of a subject are added up one after the other.
    """
    cols, rows = len(xs), len(ys)
    size = cols * rows
    cx, cy = np.array(xs), np.array(ys)

    def kernels(x: np.ndarray, y: np.ndarray, k: np.ndarray | None) -> np.ndarray:
        dx, dy = cx[None, :, None] - x[:, None, None], cy[None, None, :] - y[:, None, None]
        if k is not None:
            xx, xy, yy = (k[:, i, None, None] for i in range(3))
            return np.exp(-(xx * dx * dx + 2 * xy * dx * dy + yy * dy * dy) / 2)
        out = np.exp(-dx * dx / (2 * bandwidth * bandwidth)) * np.exp(-dy * dy / (2 * bandwidth * bandwidth))  # of x and y apart
        return out if reach is None else np.where(dx * dx + dy * dy <= reach * reach, out, 0.0)

    def grids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each subject and its grid of values, counts and weights."""
        first, of = _codes(batch, subject)
        x, y, w = (np.asarray(batch.column(c), dtype=float) for c in ("x", "y", "weight"))
        k = np.stack([np.asarray(batch.column(c), dtype=float) for c in ("kxx", "kxy", "kyy")], axis=1) if kernel else None
        out = np.zeros((len(first), 3, size))
        cell = np.minimum(cols - 1, np.floor(x / width * cols)).astype(int) * rows + np.minimum(rows - 1, np.floor(y / height * rows)).astype(int)
        np.add.at(out[:, 1], (of, cell), 1)
        np.add.at(out[:, 2], (of, cell), w)
        order = np.argsort(of, kind="stable")
        for a in range(0, len(order), POINTS):
            own = order[a : a + POINTS]
            values = kernels(x[own], y[own], None if k is None else k[own]).reshape(len(own), size) * w[own, None]
            starts = np.flatnonzero(np.diff(of[own], prepend=-1))
            out[of[own][starts], 0] += np.add.reduceat(values, starts, axis=0)
        return first, out.reshape(len(first), 3 * size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        keys = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([g.tolist() for g in held.values()], pa.list_(pa.float64()))], names=[*subject, "grid"])

        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(c).type for c in subject]
            first, found = grids(batch)
            for key, grid in zip(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in subject)) if subject else [()], found):
                held[key] = held[key] + grid if key in held else grid
                if len(held) >= HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of subjects: one for each."""
        key, total, kinds = None, None, None
        for batch in chain(batches, [None]):
            done: list[tuple[tuple, np.ndarray]] = []
            if batch is None:
                if total is not None:
                    done.append((key, total))
            else:
                kinds = [batch.column(c).type for c in subject]
                rows_of = np.asarray(batch.column("grid").flatten(), dtype=float).reshape(len(batch), -1)
                for k, grid in zip(zip(*(batch.column(c).to_pylist() for c in subject)), rows_of):
                    if total is not None and k != key:
                        done.append((key, total))
                        total = None
                    key, total = k, grid.copy() if total is None else total + grid
            for a in range(0, len(done), 100):
                part = done[a : a + 100]
                columns = [pa.array([k[i] for k, _ in part], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([g.tolist() for _, g in part], pa.list_(pa.float64()))], names=[*subject, "grid"])

    extra = [F.col(f"k.{c}").alias(f"k{c}") for c in ("xx", "xy", "yy")] if kernel else []
    schema = _schema(points, subject)
    some = points.select(*subject, F.col("x").cast("double"), F.col("y").cast("double"), F.col("weight").cast("double"), *extra).mapInArrow(partial, schema)
    whole = some.repartition(*subject).sortWithinPartitions(*subject).mapInArrow(added, schema)
    at = lambda k: F.slice("grid", k * size + 1, size)
    total = lambda k: F.aggregate(at(k), F.lit(0.0), lambda a, v: a + v)
    of = {"peak": F.array_max(at(0)), "sample_size": total(1).cast("bigint"), "total_weight": total(2)}  # before cells are rows, so that no cell is moved
    cells = whole.select(*subject, *(c.alias(n) for n, c in of.items()), F.posexplode(F.arrays_zip(at(0).alias("value"), at(1).alias("count"), at(2).alias("weight"))).alias("n", "c"))
    col, row = F.floor(F.col("n") / rows).cast("int"), (F.col("n") % rows).cast("int")
    return cells.select(*subject, col.alias("col"), row.alias("row"), "c.value", F.col("c.count").cast("bigint").alias("count"), "c.weight", *of)
