"""Operator 2, a store of token ids in ORC.

Documents are dealt by ranges of doc_id and sorted, tokenized as they stream by, and
written as one ORC file a range: integers run-length encoded by stripe, row indexes and
Bloom filters on doc_id. Files and rows ascend by doc_id. A file's documents hold their
start within the file; file totals, a few rows, turn it into the start among all ids. So
reads of stripes are independent, and lookups by doc_id skip stripes by metadata alone.

Defined results: null texts count as empty (their only id is the end id), a null doc_id
comes first, equal doc_ids stay separate rows and may spread over neighbouring files, an
empty table gives an empty result, other columns are left alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import map_batches, materialize, new_path, slices
from tokenloom.llm.packing import END_ID, with_end
from tokenloom.llm.word_bpe import word_bpe

#: Files whose totals are broadcast (16 bytes each); beyond them they are joined by a shuffle.
MOST_FILES = 1 << 20

STORE = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: ORC's own settings: 64 MB stripes, an index entry and Bloom filter every 10,000 rows.
OPTIONS = {"orc.stripe.size": str(64 << 20), "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zlib"}


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, done = word_bpe(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, off = with_end(*coder.encode_column(part.column(1)), end_id)
                n = len(part)
                values = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), part.column(0), pa.array(done + off[:-1]), pa.array(np.diff(off)), values], schema=schema)
                done += int(off[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("salt"))
    ranged = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    map_batches(ranged, run, STORE).write.options(**OPTIONS).orc(path)


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. With ``doc_ids`` the
    stripes that can't hold them are skipped by their indexes and Bloom filters."""
    stored = spark.read.schema(STORE).orc(path)
    # one row a file; totals read two columns only
    totals = materialize(stored.groupBy("shard").agg(F.sum("n_tokens").alias("all_tokens")), "totals")
    base = totals.select("shard", (F.sum("all_tokens").over(Window.orderBy("shard")) - F.col("all_tokens")).alias("base"))
    rows = stored.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else stored
    return rows.join(F.broadcast(base) if totals.count() <= MOST_FILES else base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc(stored: DataFrame) -> DataFrame:
    """The rows with the crc32 of their ids as little-endian unsigned 32-bit integers."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.int32).tobytes())
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], schema=pa.schema(fields))

    return map_batches(stored.select("doc_id", "start", "n_tokens", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the store to the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, tokenizer, end_id)
    return read_token_store(docs.sparkSession, path)
