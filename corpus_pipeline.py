"""A pipeline over the documents table: toxic documents go, recurring lines go, one document of each near-duplicate group
stays, contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again for the next one. All stages but the last return the columns of documents. Decisions are about rows, told apart by
id and text: what one row is found to be takes no other row of its id along. A row travels as one value beside its key, so
columns of documents may have any names; all but the last stage hand them on unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import bpe, decontam, linededup, simhash, toxicity
from pitchlake.llm.common import stored

#: Score from which a text counts as toxic; words of a document for each contaminated one from which it goes.
TOXIC, CONTAMINATED = 0.7, 20


def _rows(docs: DataFrame) -> DataFrame:
    """(key, row, text): the row is one value with all columns of docs, so none can clash. The key is what decisions are about:
    an id and the hash of a text. Equal rows share it, other rows of one id don't."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    return docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def _of(keys: DataFrame) -> Column:
    """Whether a row of _rows() has one of the keys (id, tie)."""
    return F.col("key.id").eqNullSafe(keys["id"]) & (F.col("key.tie") == keys["tie"])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose key isn't in gone (key)."""
    keys = stored(gone.select("key.*").distinct(), "gone")
    return _rows(docs).join(keys, _of(keys), "left_anti").select("row.*")


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text is toxic; null texts count as empty, also in the stages below."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_rows(docs).select("key", "text"), lexicon, id_col="key")
    return _without(docs, scored.where(F.col("score") >= TOXIC).select(F.col("doc_id").alias("key")))


def recurring_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that recur in other documents."""
    return linededup.drop_recurring_lines(docs, count_col=None)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach the row with the least id and tie (no id comes first); of equal rows one."""
    found = simhash.near_duplicates(_rows(docs).select("key", "text"), id_col="key")
    found = stored(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("first")), "near-duplicates")
    kept = _rows(_without(docs, found.where(F.col("key") != F.col("first")).select("key")))
    # rows that occur several times: only they are moved to keep one of each
    several = stored(found.groupBy("key").count().where("count > 1").select("key.*"), "equal-rows")
    once = kept.join(several, _of(several), "left_semi").dropDuplicates(["key"])
    return kept.join(several, _of(several), "left_anti").unionByName(once).select("row.*")


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows of which enough words stand in passages of the benchmark."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = (F.col("n_hit") > 0) & (CONTAMINATED * F.col("n_hit") >= F.col("n_words"))
    return _without(docs, found.where(bad).select(F.struct(F.col("doc_id").alias("id"), "tie").alias("key")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that is left: its tokens, their number, and digests of both directions."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.round_trip(docs, path)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    digests = (F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", *digests)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents_go),
    ("line dedup", recurring_lines_go),
    ("near duplicates", near_duplicates_go),
    ("decontamination", contaminated_documents_go),
    ("encoding", encoded),
]

#: None: SQL can't express the scores, the components and the encoding; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
