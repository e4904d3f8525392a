"""The registered queries of this subpackage: thin uses of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import ann, licenses, media, neardup, packing, pii, piece_bpe, sharding, token_store, toxicity
from tokenloom.sources.tables import dealt, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents", "doc_id", "text")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_documents(spark, sf_dir), WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.with_crc(token_store.token_store(table(spark, sf_dir, "documents"), WORD_BPE))


def op3_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sample_features(media.store(_documents(spark, sf_dir)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarize(licenses.scan_licenses(_documents(spark, sf_dir)))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.self_search(table(spark, sf_dir, "embeddings"))


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(piece_bpe.encode_decode(_documents(spark, sf_dir), PIECE_BPE))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(_documents(spark, sf_dir), spans="entities")
    return found.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",").alias("entities"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_token_store, op3_media_sniffing, op4_license_scan, op5_permutation_index, op6_piece_bpe, op7_surrogates, op8_toxicity, op9_sharding, op10_dart_minhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_sharding": sharding.oracle(sharding.SHARDS, sharding.SLOTS, "documents", "doc_id")}
