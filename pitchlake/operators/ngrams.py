"""Looking for texts that contain a term, by postings of character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter terms are looked for by grams of their own length.
N = 3


def grams_of(text: Column, n: int) -> Column:
    """The grams of n characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def postings(labels: DataFrame, label: str = "label") -> DataFrame:
    """(gram, label): each distinct text under its grams of 1 to N characters, which are some N for each of its characters.

    Stored by gram, it serves any number of searches.
    """
    own = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    every = F.flatten(F.array(*(grams_of(F.col("label"), n) for n in range(1, N + 1))))
    return own.select(F.explode(every).alias("gram"), "label")


def containing(index: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, label): the texts of an index (postings) that contain a term; empty terms aren't looked for.

    A term's grams are ordered by how many texts they stand in. The postings of the rarest are the candidates, those of the
    next rarest thin them out, and what is left is held against the term itself.
    """
    asked = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    own = F.when(F.length("term") < N, F.array("term")).otherwise(grams_of(F.col("term"), N))
    each = asked.select("term", F.explode(own).alias("gram"))
    counts = index.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "gram", "left").groupBy("term").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))  # of one term
    ranked = ranked.where(F.col("g")[0]["n"] > 0).select("term", F.col("g")[0]["gram"].alias("gram"), F.get("g", F.lit(1))["gram"].alias("second"))
    found = index.join(ranked, "gram").select("term", "label", "second")
    other = index.select(F.col("gram").alias("second"), "label")
    thinned = found.where("second is not null").join(other, ["second", "label"], "left_semi").select("term", "label")
    return found.where("second is null").select("term", "label").unionByName(thinned).where(F.col("label").contains(F.col("term")))
