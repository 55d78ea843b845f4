"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction on the sphere; a vector passes those whose inner product with it exceeds a bound. The directions are
a product code: the space is turned at random, cut into two halves, and in each half CODE unit vectors are drawn (random
orthonormal bases and their negatives, which cover more evenly than single draws). Every pair of one from each half is a
direction, CODE ** 2 of them, and TURNS turns have codes of their own. A vector is list-decoded: of each half only the code
words that can exceed the bound with the best of the other half are kept, and their pairs are tried. It passes some 35 of
half a million filters; two vectors with cosine 0.9 share one with a chance of 0.999, nearer ones all but surely (both by
simulation and by a test: three of 4000 pairs at 0.9 were missed, none at 0.93), and unrelated ones share one in 20,000 filters. Vectors that share a filter are verified.

Equal vectors are one class, compared once and counted with its size. A pair is counted in the least filter that both
pass: a row in a filter carries the vector's lesser filters, and pairs that share one of these are left to it. So links are
counted without any pair being sent, and only forests of links go on to the components. A filter with more than GROUP rows is
cut into chunks, and each pair of chunks is a task of its own.

Defined results: vectors that are null, empty, zero or that have a null or non-finite component link with nothing; vectors
of different length neither; repeated rows, also of one id, count as vectors of their own; rows without an id are linked like
others and have no say in the least id (of a component without any id it is null, and so is kept); only id and vector are
read, so extra columns can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Cosine of linked vectors; turns, code words of a half, bound of the inner product in standard deviations of a random one.
COSINE, TURNS, CODE, BOUND = 0.9, 32, 128, 3.65
#: Rows of a filter that one task compares; of a group that are compared without matrices; dimensions at least (fewer are filled up with zeros).
GROUP, FEW, WIDTH = 2048, 32, 64


@lru_cache(4)
def codes(dims: int) -> np.ndarray:
    """(TURNS, 2, dims, CODE): the code words of both halves of each turn, in the dimensions of the vectors."""
    r = np.random.default_rng(dims)
    half, out = dims // 2, np.zeros((TURNS, 2, dims, CODE), np.float32)
    for turn in out:
        turned = np.linalg.qr(r.standard_normal((dims, dims)))[0]
        for k, place in enumerate((turned[:, :half], turned[:, half:])):
            n, words = place.shape[1], []
            while sum(x.shape[1] for x in words) < CODE:
                basis = np.linalg.qr(r.standard_normal((n, n)))[0]
                words += [basis, -basis]
            turn[k] = place @ np.concatenate(words, axis=1)[:, :CODE] / np.sqrt(2)
    return out


def passed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters that the unit vectors in the rows of x pass, by row, then filter."""
    if x.shape[1] < WIDTH:
        x = np.concatenate([x, np.zeros((len(x), WIDTH - x.shape[1]), x.dtype)], axis=1)
    x = x.astype(np.float32)
    bound, rows, filters = np.float32(BOUND / np.sqrt(x.shape[1])), [], []
    for turn, (first, second) in enumerate(codes(x.shape[1])):
        a, b = x @ first, x @ second
        i, p = np.nonzero(a >= bound - b.max(axis=1)[:, None])
        j, q = np.nonzero(b >= bound - a.max(axis=1)[:, None])
        n = np.bincount(j, minlength=len(x))
        each = n[i]  # partners in the other half of each code word that is left
        of = np.repeat(np.arange(len(i)), each)
        other = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + (np.cumsum(n) - n)[i][of]
        k = np.flatnonzero(a[i, p][of] + b[j, q][other] >= bound)
        rows.append(i[of[k]])
        filters.append((turn * CODE + p[of[k]]) * CODE + q[other[k]])
    row, found = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((found, row))
    return row[order], found[order]


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x with length one, in double precision, however large or small their components are."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def numbered(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, key, dims, data): each row with its vector's bytes and their hash, null where it links with nothing; and the bytes'
    precision, single or double as the column's."""
    kind = "f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "f8"
    wanted = "float" if kind == "f4" else "double"
    slim = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast(f"array<{wanted}>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
            flat = np.asarray(pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), np.nan)).astype(kind) + 0.0  # no negative zeros
            ends = np.cumsum(sizes)
            data = []
            for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                own = flat[a:b]
                data.append(own.tobytes() if len(own) and np.isfinite(own).all() and own.any() else None)
            keys = [x and hashlib.sha256(x).digest()[:16] for x in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(data, pa.binary())], names=["vec_id", "key", "dims", "data"]
            )

    return slim.mapInArrow(run, f"vec_id {slim.schema['vec_id'].dataType.simpleString()}, key binary, dims int, data binary"), kind


def matrix(data: pa.Array, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(-1, dims)


def decoded(classes: DataFrame, kind: str) -> DataFrame:
    """classes with filters array<int>, those that each vector passes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                for k in range(0, len(own), 512):
                    part = own.slice(k, 512)
                    row, found = passed(unit(matrix(part.column("data"), d, kind)))
                    ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))], names=[*part.schema.names, "filters"])

    return classes.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, filters array<int>")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each part of a graph on n vertices with edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            return root
        for k in (root[i], root[j]):
            np.minimum.at(root, k, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def shares(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of a matrix of which two have a positive product if two lists share a number."""
    owner, number = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int64)
    known, place, count = np.unique(number, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    out = np.zeros((len(lists), int((count > 1).sum())), np.float32)
    out[owner[keep], column[place[keep]]] = 1
    return out


def links_in(x: np.ndarray, side: np.ndarray, lesser: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a group that share no lesser filter. side: if both 0 and 1 occur, they are compared with each other alone."""
    two, found = len(np.unique(side)) > 1, ([], [])
    near = np.zeros(len(x), bool)
    parts = []
    for k in range(0, len(x), 512):
        own = x[k : k + 512] @ x.T >= cosine
        own &= np.arange(len(x))[None, :] > np.arange(k, k + len(own))[:, None]
        if two:
            own &= side[k : k + 512][:, None] != side[None, :]
        i, j = np.nonzero(own)
        if len(i):
            near[i + k] = near[j] = True
            parts.append((k, np.packbits(own, axis=1)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    member = np.flatnonzero(near)
    of = shares([lesser[m] for m in member.tolist()])
    place = np.cumsum(near) - 1
    for k, packed in parts:
        own = np.unpackbits(packed, axis=1, count=len(x)).astype(bool)
        rows = np.flatnonzero(near[k : k + len(own)])
        new = own[np.ix_(rows, member)] & (of[place[rows + k]] @ of.T == 0)
        i, j = np.nonzero(new)
        found[0].append(rows[i] + k)
        found[1].append(member[j])
    return np.concatenate(found[0]), np.concatenate(found[1])


def links(classes: DataFrame, kind: str, cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """(a, b, n) of classes (cid, dims, data, n, filters). Without b: n is a share of the number of vectors linked to the class
    a. With b: a link; these connect all that links connect."""
    names = ["dims", "filter", "i", "j", "chunk", "cid", "n", "data", "lesser"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            held = [*rest, batch] if batch is not None else rest
            if not held:
                break
            now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([np.asarray(now.column(c)).astype(np.int64) for c in names[:4]])
            starts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1])
            if batch is not None:  # the last group may go on
                rest = [now.slice(int(starts[-1]))]
                now, starts = now.slice(0, int(starts[-1])), starts[:-1]
            if len(now):
                yield from compared(now, starts, keys[:, : len(now)])
            if batch is None:
                break

    def compared(now: pa.RecordBatch, starts: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(now)))
        dims, _, chunk_i, chunk_j = keys
        several = np.repeat(sizes > 1, sizes)
        for d in np.unique(dims[several]).tolist():
            take = np.flatnonzero(several & (dims == d))
            own = now.take(pa.array(take))
            x, cid, n = unit(matrix(own.column("data"), d, kind)), np.asarray(own.column("cid")), np.asarray(own.column("n"))
            chunk, split = np.asarray(own.column("chunk")), (chunk_i != chunk_j)[take]
            lists, at = own.column("lesser").flatten().to_numpy(), np.asarray(own.column("lesser").offsets)
            at = at - at[0]
            group_of = np.repeat(np.arange(len(sizes)), sizes)[take]
            first = np.flatnonzero(np.diff(group_of, prepend=-1))
            size = np.diff(np.append(first, len(take)))
            few = np.repeat(size <= FEW, size)
            i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(1, min(FEW, int(size.max()))):
                p = np.flatnonzero((group_of[:-k] == group_of[k:]) & few[:-k] & (~split[:-k] | (chunk[:-k] != chunk[k:])))
                p = p[np.einsum("ij,ij->i", x[p], x[p + k]) >= cosine]
                new = [a for a in p.tolist() if not np.isin(lists[at[a] : at[a + 1]], lists[at[a + k] : at[a + k + 1]], assume_unique=True).any()]
                i.append(np.array(new, np.int64))
                j.append(np.array(new, np.int64) + k)
            a, b = np.concatenate(i), np.concatenate(j)
            linked = np.zeros(len(take), np.int64)
            np.add.at(linked, a, n[b])
            np.add.at(linked, b, n[a])
            edges = [(cid[a], cid[b])]
            for k, m in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
                part = slice(k, k + m)
                side = (chunk[part] == chunk_j[take][k]) if split[k] else np.zeros(m, bool)
                a, b = links_in(x[part], side, [lists[at[r] : at[r + 1]] for r in range(k, k + m)], cosine)
                if len(a):
                    np.add.at(linked, a + k, n[b + k])
                    np.add.at(linked, b + k, n[a + k])
                    root = forest(m, a, b)
                    out = np.flatnonzero(root != np.arange(m))
                    edges.append((cid[root[out] + k], cid[out + k]))
            some = np.flatnonzero(linked)
            a, b = (np.concatenate(e) for e in zip(*edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cid[some], a])), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(np.concatenate([linked[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"]
            )

    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = stored(classes.select("dims", F.explode("filters").alias("filter")).groupBy("dims", "filter").count().where(F.col("count") > group), "large-filters")
    n_large = large.count()
    rows = classes.select("dims", "cid", "n", "data", "filters", F.posexplode("filters").alias("k", "filter")).select("dims", "filter", "cid", "n", "data", F.slice("filters", F.lit(1), F.col("k")).alias("lesser"))
    if n_large:
        chunks = F.ceil(F.col("count") / group).cast("int")
        known = rows.join(F.broadcast(large) if n_large <= 1_000_000 else large, ["dims", "filter"], "left").withColumn("chunk", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("cid"), chunks).cast("int")))
        other = F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))
        rows = known.withColumn("other", F.explode(other)).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    else:
        rows = rows.withColumns({c: F.lit(0) for c in ("i", "j", "chunk")})
    dealt = rows.select(*names).repartition(parts, *names[:4]).sortWithinPartitions(*names[:4])
    return dealt.mapInArrow(compare, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """vec_id, n_links (other rows whose vector has at least this cosine with it), component_id (the least id that links
    reach) and kept (whether it is the least), for each row."""
    own, kind = numbered(vectors, id_col, vector_col)
    own = stored(own, "vectors")
    classes = own.where("key is not null").groupBy("key").agg(F.first("dims").alias("dims"), F.first("data").alias("data"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    dealt = stored(decoded(classes.select("cid", "dims", "data", "n"), kind), "decoded")
    found = stored(links(dealt, kind, cosine, group), "links")
    roots = stored(components(found.where("b is not null").select("a", "b")), "roots").select(F.col("v").alias("cid"), "root")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    told = classes.select("cid", "key", "n", "least").join(roots, "cid", "left").join(counts, "cid", "left")
    told = stored(told.select("key", F.coalesce("root", "cid").alias("root"), "least", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")), "told")
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = stored(told.join(least, "root").select("key", "n_links", "component_id"), "told")
    of = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    rows = own.select("vec_id", "key").join(told, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), of.alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: DuckDB SQL of the registered query.
ORACLE = f"""
WITH RECURSIVE
own AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (SELECT * FROM own WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.r < b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT r, r AS o FROM own UNION SELECT t.r, b FROM reached t JOIN sides s ON s.a = t.o),
least AS (SELECT t.r, min(vec_id) AS component_id FROM reached t JOIN own ON own.r = t.o GROUP BY t.r),
counts AS (SELECT a AS r, count(*) AS n FROM sides GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM own JOIN least USING (r) LEFT JOIN counts USING (r)
"""
