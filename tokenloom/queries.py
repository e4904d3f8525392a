"""The registered queries of the engine itself, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.operators import encode
from tokenloom.plans import artifacts, decoding, encodings, models, text

FAMILIES = [text, encodings, models, decoding, artifacts]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all documents encoded with a WordPiece vocabulary, one row a token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode.tokens_relation(encode.encode(docs, models.wordpiece_spec(spark, sf_dir)), keys=["doc_id"])


def queries() -> dict:
    return {name: f for m in FAMILIES for name, f in m.queries().items()}


def oracle_sql() -> dict:
    return {name: sql for m in FAMILIES for name, sql in m.oracle_sql().items()}
