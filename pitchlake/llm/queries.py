"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, caps, decontam, linededup, lz, periods, pii, quality, simhash, tokenfiles, toxicity, variants, warc
from .labelled import held_out


#: The key of surrogates in the registered query; a real run brings its own secret.
KEY = "key-of-the-registered-query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.with_edits(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return changed.select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        warc.page_column("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_column("refers_to").alias("refers_to")
    )


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_and_counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.runs(periods.with_planted_periods(table(spark, sf_dir, "documents"))))


def op12_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.words(table(spark, sf_dir, "documents"), thin=True))


def op13_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lz_fingerprints, op2_byte_bpe, op3_pii_surrogates, op4_warc_zstd, op5_separator_scan, op6_inverted_index, op7_toxicity, op8_line_templates, op9_quality, op10_simhash_anchors, op11_block_convolution, op12_asymmetric_chunks, op13_spherical_caps)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_zstd": warc.ORACLE, "op6_inverted_index": decontam.ORACLE, "op8_line_templates": linededup.ORACLE, "op11_block_convolution": periods.ORACLE, "op12_asymmetric_chunks": variants.ORACLE, "op13_spherical_caps": caps.ORACLE}
