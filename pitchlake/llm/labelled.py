"""The labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def held_out(doc_id="doc_id"):
    """Rows that no classifier learns from: crc32 of the decimal id leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def least_hashes(n: int, most: int) -> int:
    """A bound below which about 2 * most of n hashes of 64 bits lie, or all."""
    return (1 << 63) - 1 if n <= 2 * most else -(1 << 63) + (2 * most << 64) // n


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled rows that aren't held out: those with the least hashes of doc_id.

    `most` bounds what is broadcast and what a fit may collect: of rows with one doc_id the text with the least hash
    counts, and of several labels of a document the least. Rows without a label are left out. The sample is stored once.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    # of hashes below the bound there are twice `most` or all, so that no task sends many to be ordered
    bound = least_hashes(usable.count(), most)
    chosen = usable.where(F.xxhash64("doc_id") <= bound).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("t")).join(F.broadcast(chosen), "doc_id")
    return stored(found.groupBy("doc_id", "y").agg(F.min("t").alias("t")).select("t.text", "y"), "sample")
