"""Segments with their places: what a pre-tokenizer gives, as rows or as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.pretokenizers import PreTokenizer
from tokenloom.kernels import batches
from tokenloom.session import ship

SPOTS = "array<struct<start: int, end: int>>"
_SPOT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PART = 1 << 20
SEGMENT_ROW = T.StructType().add("pos", "integer").add("segment", "string").add("start", "integer").add("end", "integer")


def _spots(in_bytes: bool):
    @F.arrow_udf(SPOTS)
    def run(texts: pa.Array, segments: pa.Array) -> pa.Array:
        out = [_placed(texts[i:j], segments[i:j], in_bytes) for i, j in batches.slices(texts, _PART)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(_SPOT))

    return run


def _placed(texts: pa.Array, segments: pa.Array, in_bytes: bool) -> pa.Array:
    first, flat, lost = batches.flattened(texts, segments)
    start = batches.places(texts, flat, first, lost)
    end = start + batches.lengths(flat)
    if in_bytes:  # a character's place among all bytes, less that of its text
        points = batches.code_points(texts)
        before = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64))])
        begin = np.concatenate([[0], np.cumsum(batches.lengths(texts))])[:-1][np.repeat(np.arange(len(texts)), np.diff(first))]
        start, end = (before[begin + x] - before[begin] for x in (start, end))
    spots = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), spots, mask=pa.array(lost))


def places(text: Column, segments: Column, unit: str = "characters") -> Column:
    """Where the segments stand in the text, each behind the one before; ``unit`` is
    characters (code points) or bytes (of UTF-8)."""
    return _spots(unit == "bytes")(text, segments)


def segments_relation(df: DataFrame, split: PreTokenizer, text: str = "text", keys: list[str] | None = None, unit: str = "characters") -> DataFrame:
    """One row a segment: the keys, pos, segment, start, end. Texts have to hold their
    segments unchanged. Workers give the rows themselves."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != text] if keys is None else keys
    cut = df.select(*kept, F.col(text).alias("__t"), split(F.col(text)).alias("__s"))
    schema, in_bytes = T.StructType([*(df.schema[k] for k in kept), *SEGMENT_ROW.fields]), unit == "bytes"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *own, texts, segments = batch.columns
        for i, j in batches.slices(texts, _PART):
            placed = _placed(texts[i:j], segments[i:j], in_bytes)
            spots, flat = placed.flatten(), batches.flattened(texts[i:j], segments[i:j])[1]
            yield from batches.exploded([c[i:j] for c in own], placed, [flat, spots.field("start"), spots.field("end")], schema.names)

    return batches.mapped(cut, run, schema)
