"""Operator 3, media columns with signature sniffing.

An Aho-Corasick automaton over the magic bytes of the known formats finds every place where
a medium may start. A validator of the format then walks its structure (chunks, blocks,
pages, markers; checksums where the format has them) and either gives the medium's length
or rejects the place. What starts at byte 0 and spans the whole value corrects the declared
type; valid media inside others are carved as spans.

Defined results: a null value counts as empty, has no detected type and no spans; a value
with no valid structure has the type application/octet-stream; overlapping finds inside a
found medium are listed too, by offset; an empty table gives an empty result; equal values
give equal results; other columns are left alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_batches, materialize, slices, utf8

UNKNOWN = "application/octet-stream"
#: Samples are stored as unsigned 8-bit mono PCM at this nominal rate.
RATE = 8000
PAD = 64
#: Bytes of values that are Python objects at a time (a longer one alone).
PART_BYTES = 1 << 20


def wav(samples: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit samples."""
    n = len(samples)
    fmt = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + RATE.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    body = b"WAVE" + fmt + b"data" + n.to_bytes(4, "little") + samples + b"\0" * (n % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def riff_chunks(data: bytes, at: int) -> tuple[int, dict[bytes, tuple[int, int]]] | None:
    """Length of a RIFF file and its chunks (place, size), if the chunks fill it exactly."""
    if at + 12 > len(data):
        return None
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if end > len(data):
        return None
    chunks, p = {}, at + 12
    while p + 8 <= end:
        size = int.from_bytes(data[p + 4 : p + 8], "little")
        chunks.setdefault(data[p : p + 4], (p + 8, size))
        p += 8 + size + size % 2
    return (end - at, chunks) if p == end else None


def wav_samples(data: bytes, at: int = 0) -> bytes:
    """The samples of a valid 8-bit WAVE file."""
    found = riff_chunks(data, at)
    if found is None or data[at + 8 : at + 12] != b"WAVE":
        raise ValueError("not a WAVE file")
    begin, size = found[1][b"data"]
    return data[begin : begin + size]


def _riff(data: bytes, at: int) -> tuple[str, int] | None:
    found = riff_chunks(data, at)
    kind = data[at + 8 : at + 12]
    if found and kind == b"WAVE" and found[1].get(b"fmt ", (0, 0))[1] >= 16 and b"data" in found[1]:
        return "audio/wav", found[0]
    if found and kind == b"WEBP" and found[1].keys() & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "image/webp", found[0]
    return None


def _png(data: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(data):
        size, kind = int.from_bytes(data[p : p + 4], "big"), data[p + 4 : p + 8]
        if p + 12 + size > len(data) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(data[p + 4 : p + 8 + size]) != int.from_bytes(data[p + 8 + size : p + 12 + size], "big"):
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(data: bytes, at: int) -> tuple[str, int] | None:
    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    if at + 13 > len(data):
        return None
    flags, p = data[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 128 else 0
    seen = False
    while p < len(data):
        if data[p] == 0x3B:
            return ("image/gif", p + 1 - at) if seen else None
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 <= len(data):
            flags, seen = data[p + 9], True
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return None
    return None


def _jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    p, frame = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF:
        marker = data[p + 1]
        if marker == 0xD9:
            return ("image/jpeg", p + 2 - at) if frame else None
        size = int.from_bytes(data[p + 2 : p + 4], "big")
        if size < 2:
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if marker == 0xDA:  # entropy-coded bytes: on to the next marker that isn't stuffing or a restart
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    return None
                if data[p + 1] != 0 and not 0xD0 <= data[p + 1] <= 0xD7:
                    break
                p += 2
            if data[p + 1] == 0xD9:
                return ("image/jpeg", p + 2 - at) if frame else None
    return None


def _bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(data):
        return None
    size, reserved, offset, header = (int.from_bytes(data[at + i : at + i + 4], "little") for i in (2, 6, 10, 14))
    ok = header in (12, 40, 52, 56, 108, 124) and not reserved and 14 + header <= offset <= size and at + size <= len(data)
    return ("image/bmp", size) if ok else None


def _ogg(data: bytes, at: int) -> tuple[str, int] | None:
    p, begun = at, False
    while data[p : p + 4] == b"OggS" and p + 27 <= len(data):
        flags, segments = data[p + 5], data[p + 26]
        if data[p + 4] or not begun and not flags & 2 or p + 27 + segments > len(data):
            return None
        p, begun = p + 27 + segments + sum(data[p + 27 : p + 27 + segments]), True
        if p > len(data):
            return None
        if flags & 4:
            return "audio/ogg", p - at
    return None


class _Marks:
    """The places of the marks that end a PDF file, found once for each value."""

    def __init__(self, data: bytes):
        self.ends, self.starts = ([m.start() for m in re.finditer(mark, data)] for mark in (b"%%EOF", b"startxref"))


def _pdf(data: bytes, at: int, marks: _Marks | None = None) -> tuple[str, int] | None:
    if not data[at + 5 : at + 6].isdigit() or data[at + 6 : at + 7] != b".":
        return None
    marks = marks or _Marks(data)
    k = bisect_left(marks.ends, at)
    end = marks.ends[k] if k < len(marks.ends) else -1
    j = bisect_right(marks.starts, end - 9) - 1
    start = marks.starts[j] if end >= 0 and j >= 0 and marks.starts[j] >= at else -1
    place = data[start + 9 : min(end, start + 64)].split() if start >= 0 else []
    ok = len(place) == 1 and place[0].isdigit() and end - start < 64 and int(place[0]) < start - at
    return ("application/pdf", end + 5 - at) if ok else None


#: Magic bytes of the formats (fixed values) and what validates them.
MAGIC = {b"RIFF": _riff, b"\x89PNG\r\n\x1a\n": _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg, b"BM": _bmp, b"OggS": _ogg, b"%PDF-": _pdf}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in MAGIC:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


_SIGNATURES = _automaton()


def sniff(data: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The type of a value and the media inside it (type, offset, length)."""
    kind, inside, marks = UNKNOWN, [], None
    for end, magic in _SIGNATURES.iter(data.decode("latin-1")):
        at = end + 1 - len(magic)
        if magic == b"%PDF-":
            marks = marks or _Marks(data)
            found = _pdf(data, at, marks)
        else:
            found = MAGIC[magic](data, at)
        if found and at == 0 and found[1] == len(data):
            kind = found[0]
        elif found:
            inside.append((found[0], at, found[1]))
    return kind, sorted(inside, key=lambda x: (x[1], -x[2]))


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared type and a media column that holds the text's UTF-8 bytes,
    zero-padded to a positive multiple of 64, as 8-bit samples."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                data, off = utf8(part.column(1))
                raw, ends = data.tobytes(), off.tolist()
                media = [wav(raw[i:j].ljust(max(PAD, -(-(j - i) // PAD) * PAD), b"\0")) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(["audio/wav"] * len(part)), pa.array(media, pa.binary())], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, declared string, media binary")


SNIFFED = "media_type string, corrected boolean, embedded array<struct<type: string, offset: long, length: long>>"
SPANS = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def values_of(col: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column, null as empty, without copying the column."""
    data, off = utf8(col)
    view, ends = memoryview(data), off.tolist()
    return (view[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def sniff_column(rows: DataFrame, media: str = "media", declared: str | None = "declared") -> DataFrame:
    """``rows`` with media_type (the type found), corrected (whether it contradicts the
    declared one) and embedded (media carved from within)."""
    taken = [f for f in rows.schema.fields if f.name not in ("media_type", "corrected", "embedded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in slices(batch, media, PART_BYTES):
                values = [sniff(bytes(x)) for x in values_of(part.column(names.index(media)))]
                said = part.column(names.index(declared)).to_pylist() if declared else [None] * len(values)
                more = [pa.array([k for k, _ in values], pa.string()), pa.array([d is not None and d != k for d, (k, _) in zip(said, values, strict=True)]), pa.array([[dict(zip(("type", "offset", "length"), s, strict=True)) for s in inside] for _, inside in values], SPANS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, "media_type", "corrected", "embedded"])

    kept = rows.select(*[F.col(f"`{f.name}`") for f in taken])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in taken), SNIFFED])
    return map_batches(kept, run, schema)


def carve(media: bytes, offset: int, length: int) -> bytes:
    return media[offset : offset + length]


def sample_features(stored: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """What sniffing and reading back give for stored 8-bit sound (doc_id, n_bytes, the media
    column and the declared type), one row a value. A value that isn't valid sound of this
    kind has no payload, and its type says what it is instead."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def features(value: bytes, said: str | None) -> tuple:
        kind, spans = sniff(value)
        payload = wav_samples(value) if kind == "audio/wav" else b""
        levels = np.frombuffer(payload, np.uint8)
        mean = int(levels.sum(dtype=np.int64)) * 1000 // max(1, len(levels))
        carved = ",".join(f"{t}@{offset}+{length}" for t, offset, length in spans)
        feature = f"{kind};corrected={int(said is not None and said != kind)};samples={len(levels)};mean={mean / 1000:.3f};peak={int(levels.max(initial=0))};silent={int((levels == 0).sum())};embedded={carved}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(value), hashlib.sha256(value).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", PART_BYTES):
                out = [features(bytes(x), d) for x, d in zip(values_of(part.column(2)), part.column(3).to_pylist(), strict=True)]
                columns = [pa.array(c, f[1]) for c, f in zip(zip(*out, strict=True), fields[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=pa.schema(fields))

    kept = stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col(media).alias("media"), F.col(declared).cast("string").alias("declared"))
    return map_batches(kept, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame) -> DataFrame:
    """Stores the texts of ``docs`` as a media column in the shared folder."""
    return materialize(encode_texts(docs), "media", **{"parquet.block.size": str(16 << 20)})  # a row group is in memory at once
