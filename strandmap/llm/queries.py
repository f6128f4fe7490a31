"""The corpus queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, langid, licences, line_dedup, mixing, neardup, oracles, quality, token_shards, warc
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.by_document(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(mixing.DOMAINS)], "rate")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_shards.read_shards(token_shards.write_shards(docs, tokenizer_path()), docs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def remainder(n: int, of: str = "doc_id"):
    return F.crc32(F.col(of).cast("string").cast("binary")) % n


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(4) == 2
    out = langid.identify(docs, langid.fit(docs, held_out=held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder(5) == 0
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), held_out=held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.to_hex(F.col("sketch")).alias("fingerprint"),
        fingerprints.to_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


QUERIES = {f.__name__: f for f in (op1_licences, op2_mixing, op3_token_shards, op4_line_dedup, op5_decontamination, op6_language, op7_quality, op8_warc, op9_near_duplicates, op10_fingerprints)}
ORACLES = oracles.ORACLES
