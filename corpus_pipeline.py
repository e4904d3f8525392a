"""A corpus pipeline over the table ``documents``: toxic documents go, one document of each
group of near copies stays, personal data get surrogates, and what is left is packed into
sequences. Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Null texts count as empty; they stay unless they are copies of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import neardup, packing, pii, toxicity
from tokenloom.llm.common import new_path, remove
from tokenloom.llm.queries import WORD_BPE
from tokenloom.sources.tables import spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of ``docs`` that aren't held out; drops what reaches the threshold."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each class."""
    return neardup.drop_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates into text, and text's new length into n_chars where it changed."""
    return pii.replace(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of at most 4096 tokens."""
    packed = packing.pack_documents(docs, WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what the one before wrote."""
    docs, paths = spread(table(spark, sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        paths.append(new_path(spark, f"stage-{name}"))
        stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
        for done in paths[:-1]:
            remove(spark, done)
        del paths[:-1]
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads what packing wrote
    for done in paths:
        remove(spark, done)
    return out
