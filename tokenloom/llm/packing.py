"""Operator 1, best-fit packing with bound-certified repacking.

Items are dealt at random to groups of a bounded number of rows and each group is packed by
best-fit decreasing. Dual-feasible functions give a lower bound on the bins a group needs:
where best fit meets it, the group is certified, and keeps all bins that are nearly full. A
group with a gap to its bound gives back every bin that isn't full. The given-back items
form the next, smaller round, dealt anew with those of other groups, until one group holds
all that is left or a round places next to nothing for good (less than one item in
``LEAST_SHARE``; then more rounds would only deal the same items again, and each group keeps
what it packed, with its own certificate). No step sees more than about ``GROUP_ROWS`` items
of a group at once, and no step needs the ids themselves.

Defined results: a null text counts as empty (its only id is the end id); equal and
repeated rows are separate items, told apart by a row number; an empty table gives an
empty result; columns other than doc_id and text are left alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import discard, map_batches, materialize, slices
from tokenloom.llm.word_bpe import word_bpe

CAPACITY = 4096
END_ID = 1
#: Items that one group packs at once, on average.
GROUP_ROWS = 4096
#: A certified group gives back bins with more than this part of the capacity free, since
#: other groups may have what fits.
SLACK = 128
LEAST_SHARE = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each text's ids."""
    ends = off + np.arange(len(off))
    out = np.full(int(ends[-1]), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[ends[1:] - 1] = False
    out[own] = ids
    return out, ends


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: only documents longer than ``capacity`` are cut.
    ``item`` numbers the pieces of all documents apart, also of repeated rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("item", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = word_bpe(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, off = with_end(*coder.encode_column(part.column(1)), end_id)
                sizes = np.diff(off)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                data, begin = memoryview(ids.tobytes()), (off[row] + start) * 4
                crc = [zlib.crc32(data[i:j]) for i, j in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(number + np.arange(len(row)))], schema=schema)
                number += len(row)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the total length and of two families of
    dual-feasible functions (rounding to multiples of 1/k, and thresholds that drop small
    items and fill large ones)."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths.astype(np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 33):
        stretched = (k + 1) * sizes
        # times k * capacity: x stays where (k + 1) x is whole, else floor((k + 1) x) / k
        value = np.where(stretched % capacity == 0, sizes * k, stretched // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    total, number = np.cumsum(sizes * counts), np.cumsum(counts)
    small = np.concatenate([[0], sizes[sizes * 2 <= capacity] + 1, [1]])
    small = small[small * 2 <= capacity]  # items below it count nothing, above capacity - it count whole
    low, high = np.searchsorted(sizes, small, side="left"), np.searchsorted(sizes, capacity - small, side="right")
    middle = np.append(0, total)[high] - np.append(0, total)[low]
    big = number[-1] - np.append(0, number)[high]
    return max(best, int((big + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, items from long to short into the fullest bin that still
    has room (ties: the youngest); and the free space of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit g: some bin has exactly g free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                some &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - size
        if room > size:
            by_free[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets, np.array(free, np.int64)


def _placer(capacity: int, level: int, last: bool, names: list[str]):
    """Packs one group; marks the items of the bins that it gives back."""

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offset, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if last:
            back = np.zeros(len(free), bool)
        else:
            back = free > (0 if len(free) > bound else capacity // SLACK)
            back[free.argmax()] = True
        return pdf.assign(sequence_id=(level << 56) + (int(key[0]) << 28) + bins, offset=offset, round=np.int32(level), group_bins=len(free), group_bound=bound, given_back=back[bins])[names]

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id, offset, round, and the certificate of the group that placed the
    item (group_bins, group_bound) to ``items``, which have length (1 to capacity) and
    item (distinct). Each round's placements are written to the shared folder once."""
    out_schema = T.StructType([*items.schema.fields, *T._parse_datatype_string("sequence_id long, offset long, round int, group_bins long, group_bound long, given_back boolean").fields])
    pool, done, level, before = items, [], 0, None
    while True:
        left = pool.count()
        groups = max(1, -(-left // group_rows))
        last = groups == 1 or before is not None and (before - left) * LEAST_SHARE < before
        group = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)).alias("group")
        placed = materialize(pool.groupBy(group).applyInPandas(_placer(capacity, level, last, out_schema.names), out_schema), f"packing-{level}")
        done.append(placed.where(~F.col("given_back")).drop("given_back"))
        if last:
            break
        pool, level, before = placed.where("given_back").select(*items.columns), level + 1, left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenizes whole documents once and packs their pieces; see ``token_pieces``, ``pack``."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    out = pack(pieces, capacity)  # reads what its rounds wrote
    discard(pieces)
    return out
