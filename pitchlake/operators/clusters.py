"""K-means over style vectors: several seeded starts that advance together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARTS, ITERATIONS = 10, 300


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (starts, rows, clusters) of rows to the centres (starts, clusters, width) of all starts, by one product."""
    starts, k, width = centres.shape
    flat = centres.reshape(-1, width)
    squared = (x * x).sum(axis=1)[:, None] - 2 * (x @ flat.T) + (flat * flat).sum(axis=1)[None, :]
    return np.maximum(squared, 0).reshape(len(x), starts, k).transpose(1, 0, 2)


def _unit(seed: int, start: int, step: int, key: str) -> float:
    """A number in (0, 1) that depends on the row and the step alone, not on how rows are dealt."""
    return (int.from_bytes(hashlib.blake2b(f"{seed}/{start}/{step}/{key}".encode(), digest_size=7).digest(), "big") + 1) / (2**56 + 2)


def _passed(ready: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], list]) -> list:
    """One value from each task: of(batches) -> [numbers], as an array that the driver adds up or compares; its size doesn't depend on the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = of(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], names=["v"])

    return [np.array(r["v"]) for r in ready.mapInArrow(run, "v array<double>").collect()]


def first_centres(ready: DataFrame, k: int, width: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, width): centres that are drawn far from each other, each with a chance in proportion to its squared distance from
    those before it (all the same for the first). The row with the least -log(u) / weight is such a draw, so a pass over the rows
    finds the next centre of all starts, and a task hands on one row for each start."""
    centres = np.zeros((starts, 0, width))
    for step in range(k):

        def draw(batches: Iterator[pa.RecordBatch], centres=centres, step=step):
            best = np.full((starts, 1 + width), np.inf)
            for batch in batches:
                x, keys = _matrix(batch.column("features"), width), batch.column("key").to_pylist()
                weight = distances(x, centres).min(axis=2) if step else np.ones((starts, len(x)))
                for s in range(starts):
                    race = -np.log([_unit(seed, s, step, key) for key in keys])
                    race = np.divide(race, weight[s], out=np.full(len(x), 1e300), where=weight[s] > 1e-12)
                    at = np.lexsort((keys, race))[0] if len(x) else None
                    if at is not None and race[at] < best[s, 0]:
                        best[s] = [race[at], *x[at]]
            return best.reshape(-1).tolist() if np.isfinite(best).all() else None

        found = np.stack(_passed(ready, draw)).reshape(-1, starts, 1 + width)
        least = found[..., 0].argmin(axis=0)
        centres = np.concatenate([centres, found[least, np.arange(starts), 1:][:, None, :]], axis=1)
    return centres


def fit(ready: DataFrame, k: int, width: int, starts: int = STARTS, seed: int = 42, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """(k, width) centres and inertia of the best of several starts. ready: key string, features array<double>.

    A pass assigns all rows to the centres of all starts and hands on sums and numbers of rows by start and cluster; starts
    go on until none of their centres moves. A cluster that has lost all rows keeps its centre.
    """
    centres = first_centres(ready, k, width, starts, seed)
    inertia = np.full(starts, np.inf)
    for _ in range(iterations):

        def assign(batches: Iterator[pa.RecordBatch], centres=centres):
            total = np.zeros((starts, k, width + 2))
            for batch in batches:
                x = _matrix(batch.column("features"), width)
                far = distances(x, centres)
                nearest = far.argmin(axis=2)
                for s in range(starts):
                    for c in range(k):
                        own = nearest[s] == c
                        total[s, c] += [*x[own].sum(axis=0), own.sum(), far[s, own, c].sum()]
            return total.reshape(-1).tolist()

        total = np.sum(_passed(ready, assign), axis=0).reshape(starts, k, width + 2)
        count = total[..., width : width + 1]
        new = np.divide(total[..., :width], count, out=centres.copy(), where=count > 0)
        inertia, moved = total[..., width + 1].sum(axis=1), np.abs(new - centres).max()
        centres = new
        if moved <= 1e-9:
            break
    best = int(inertia.argmin())
    return centres[best], float(inertia[best])


def cluster_players(vectors: DataFrame, keys: list[str], k: int = 4, seed: int = 42, starts: int = STARTS) -> tuple[DataFrame, list[list[float]], float]:
    """K-means clusters of style vectors, the best of several starts: players with their cluster and squared distance, the
    centres and the inertia (3 decimals both). Missing percentiles count as 50. Clusters are numbered by their centres."""
    if vectors.limit(k).count() < k:
        raise ValueError(f"{k} clusters need at least {k} players")
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in vectors.columns if c != "vector"))
    ready = vectors.select("*", text.alias("key"), F.array(*(F.coalesce(F.col("vector")[m], F.lit(50.0)) for m in keys)).alias("features")).persist()
    try:
        centres, inertia = fit(ready.select("key", "features"), k, len(keys), starts, seed)
    finally:
        ready.unpersist()
    centres = np.array(sorted(centres.tolist()))
    squared = [F.aggregate(F.zip_with("features", F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b) for c in centres.tolist()]
    nearest = F.array_min(F.array(*(F.struct(d.alias("distance"), F.lit(i).alias("cluster")) for i, d in enumerate(squared))))
    out = ready.withColumn("n", nearest).select(*vectors.columns, "n.cluster", "n.distance")
    return out, np.round(centres, 3).tolist(), round(inertia, 3)
