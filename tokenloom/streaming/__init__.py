"""Encoding of streams. Encoding is stateless, so a stream takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.encode import encode
from tokenloom.spec import EncodeOptions, TokenizerSpec


def encode_stream(stream: DataFrame, spec: TokenizerSpec, text: str = "text", output: str = "encoding", options: EncodeOptions | None = None) -> DataFrame:
    """A stream with its encodings; no state, no watermark, every output mode but complete."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return encode(stream, spec, text, None, output, options)


def write_encodings(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends encodings to Parquet, each input row once; the checkpoint has to be on storage
    that all executors share."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
