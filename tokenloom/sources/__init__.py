"""Artifacts as relations. They are small files, read on the driver, with lines in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.artifacts import loader
from tokenloom.artifacts.piece_model import TYPE_NAMES, parse_piece_model


def vocabulary(spark: SparkSession, source) -> DataFrame:
    """token, id of a vocab.txt."""
    return spark.createDataFrame(list(loader.read_vocab_text(source).items()), "token string, id int")


def merges(spark: SparkSession, source) -> DataFrame:
    """left, right, rank of a merges.txt."""
    rows = [(a, b, i) for i, (a, b) in enumerate(loader.read_merges(source))]
    return spark.createDataFrame(rows, "left string, right string, rank int")


def ranks(spark: SparkSession, source) -> DataFrame:
    """bytes, rank of a .tiktoken file."""
    return spark.createDataFrame([(bytearray(b), r) for b, r in loader.read_ranks(source).items()], "bytes binary, rank int")


def pieces(spark: SparkSession, source) -> DataFrame:
    """id, piece, score, type of a piece model."""
    model = parse_piece_model(loader.read_bytes(source))
    return spark.createDataFrame([(p.id, p.text, p.score, TYPE_NAMES[p.type]) for p in model.pieces], "id int, piece string, score float, type string")


def variants(spark: SparkSession, directory: str) -> DataFrame:
    """position, variant, file of the tokenizers in a folder, as they would be tried."""
    rows = [(i, v, f) for i, (v, f) in enumerate(loader.discover(directory))]
    return spark.createDataFrame(rows, "position int, variant string, file string")
