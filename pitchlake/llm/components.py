"""Connected components of an undirected graph, by contraction.

In each round every vertex points at its least neighbour (a minimum that is summed before the shuffle), the pointers are
followed a second time, and the edges are drawn anew between the roots. Each round writes its tables to the shared
folder, so lineage stays short and an executor may be lost at any time. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) bigint, any order, repeats and loops allowed. (v, root) for each vertex: the least vertex it reaches."""
    pairs = edges.where("a is not null and b is not null").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct()
    pairs = stored(pairs, "edges")
    names = None
    while True:
        least = stored(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        again = least.select(F.col("a").alias("p"), F.col("p").alias("q"))
        least = stored(least.join(again, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "parents")
        if names is None:
            names = least.select(F.col("a").alias("v"), F.col("p").alias("root"))
        else:
            names = stored(names.join(least.select(F.col("a").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "names")
        half = stored(pairs.join(least, "a").select(F.col("p").alias("a"), "b"), "edges")
        new = half.join(least.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        pairs = stored(new.where("a <> b").distinct(), "edges")
        if pairs.isEmpty():
            return names
