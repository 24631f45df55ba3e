"""The registered queries opN_<name> and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, chat_format, exact_dedup, katz, kd_sharding, near_dedup, packing, shared, topk, toxicity, warc
from veritab.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), shared.new_path(spark, "warc"))
    records = shared.materialize(warc.read_warc(manifest.select("path", "bytes"), payloads=False).drop("url", "payload"), "warc-records")
    warc.require_whole(records, manifest)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.round_trip_digests(encoded, vocabulary)


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.kd_shards(_table(spark, sf_dir, "documents"), shards=8).drop("leaf")


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=85)


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_rows(*chat_format.borrowed_replies(_table(spark, sf_dir, "conversations")))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    scored = katz.katz_scores(_table(spark, sf_dir, "documents"), remainder != 2)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared.new_path(spark, "digest-index"))
    found = exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), index)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(packing.token_rows(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [f for name, f in globals().items() if name.startswith("op")]
    own.sort(key=lambda f: int(f.__name__[2:].split("_")[0]))
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
