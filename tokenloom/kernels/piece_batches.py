"""Pieces of a whole batch of texts by piece models. A normalized text is taken apart where no
piece reaches across, each distinct part is encoded once, and all else is done by arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tokenloom.kernels import batches
from tokenloom.spec import PIECES


def encode(model, texts: pa.Array, limit: int | None, wanted: tuple = tuple(PIECES.names)) -> pa.StructArray:
    """What ``model.encode`` gives for each text; ``model.cuts`` and ``model.part`` cut and encode.
    Fields that aren't wanted are null."""
    placed = "offsets" in wanted
    made, source, solid, edges, origin = [_NONE], [_NONE], [np.zeros(0, bool)], [0], []
    past = 0
    for text in texts.to_pylist():
        if text is not None:
            points = _points(text)
            normal, at = model.arrays(text, points)
            made.append(normal)
            if placed:
                source.append(at)
                solid.append(np.append(~batches.blank(points), False))  # behind the last stands nothing
        edges.append(edges[-1] + (len(normal) if text is not None else 0))
        origin.append(past)
        past += len(points) + 1 if text is not None else 0
    normal, edges = np.concatenate(made).astype(np.uint32), np.array(edges)
    begin = model.cuts(normal, edges)
    length = np.diff(begin)
    distinct, part = _numbered(normal, begin)
    entries, known = batches.entries_of(model, distinct, model.part, getattr(model, "fresh_parts", None))
    entry = known[part]
    first = np.searchsorted(begin, edges)
    if hasattr(model, "settled"):
        entry = model.settled(entries, entry, length, first, lambda i: distinct[part[i]])
    count = entries.count[entry]
    ends = np.concatenate([[0], np.cumsum(count)])
    segment = np.repeat(np.arange(len(entry)), count)
    at = np.arange(ends[-1]) + (entries.begin[entry] - ends[:-1])[segment]
    rows = ends[first]
    if limit is not None:
        within = np.arange(ends[-1]) - np.repeat(rows[:-1], np.diff(rows)) < limit
        segment, at = segment[within], at[within]
        rows = np.concatenate([[0], np.cumsum(np.minimum(np.diff(rows), limit))])
    ids, token, start, stop = entries.flat
    out, spots = {"ids": pa.array(ids[at])}, None
    if "tokens" in wanted:
        out["tokens"] = entries.tokens.take(pa.array(token[at]))
    if placed:
        row, source, solid = np.repeat(np.array(origin), np.diff(rows)), np.concatenate(source), np.concatenate(solid)
        # a character's place among the originals of all texts
        seen = (source >= 0) & solid[source + np.repeat(np.array(origin, np.int64), np.diff(edges))]
        a, b = _spans(source, seen, solid, row, begin[segment] + start[at], begin[segment] + stop[at])
        spots = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["start", "end"])
        out["offsets"] = spots
    if "words" in wanted:
        out["words"] = pa.nulls(len(at), pa.int32())
    return batches.struct_of(pa.array(rows, pa.int32()), texts.is_null(), out)


_NONE = np.zeros(0, np.int64)
#: An odd number, whose powers mark the places in a part.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _numbered(points: np.ndarray, begin: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct ones among the parts begin[i]:begin[i + 1] of a text, and each part's number
    among them. Parts are told apart by hashes; every part is then compared with its like."""
    n, length = len(begin) - 1, np.diff(begin)
    if not n:
        return [], np.zeros(0, np.int64)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    power = lambda base, k: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(k, base, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power(_BASE, len(points))[:-1])])
    hashed = (sums[begin[1:]] - sums[begin[:-1]]) * power(_INVERSE, len(points))[begin[:-1]]
    _, like, part = np.unique(hashed, return_index=True, return_inverse=True)
    same = like[part]
    moved = np.repeat(begin[same] - begin[:-1], length) + np.arange(begin[0], begin[-1])
    if (length[same] == length).all() and (points[np.minimum(moved, len(points) - 1)] == points[begin[0] : begin[-1]]).all():
        return [text[a:b] for a, b in zip(begin[like].tolist(), begin[like + 1].tolist(), strict=True)], part
    numbers: dict[str, int] = {}  # different parts have one hash
    at = begin.tolist()
    part = [numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(at, at[1:], strict=False)]
    return list(numbers), np.array(part, np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _spans(source: np.ndarray, seen: np.ndarray, solid: np.ndarray, origin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``SourceText.span`` for pieces at start:end of all normalized texts together."""
    if not len(start):
        return start, end
    at = lambda flags: (np.concatenate([np.flatnonzero(flags), [-1]]), np.concatenate([[0], np.cumsum(flags)]))
    spot, before = at(seen)
    low, high = before[start], before[end]
    head, tail = source[spot[low]], source[spot[high - 1]]
    visible = (high > low) & (tail > 0)
    spot, before = at(source >= 0)
    low, high = before[start], before[end]
    placed = high > low
    one, last = np.where(placed, source[spot[low]], 0), np.where(placed, source[spot[high - 1]], -1)
    behind = placed & solid[origin + last + 1]
    a = np.where(visible, head, np.where(behind, last + 1, one))
    b = np.where(visible, tail + 1, np.where(behind, last + 2, np.where(placed, last + 1, 0)))
    return a, b
