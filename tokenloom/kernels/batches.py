"""Pieces of a whole batch of texts at once: each distinct segment is encoded once, what the
segments stand for is then gathered by array operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenloom.kernels.pieces import SPACES
from tokenloom.spec import PIECES

_BLANK = np.zeros(0x3002, bool)
_BLANK[[ord(c) for c in SPACES]] = True


#: Segments that a worker remembers, and their characters; forgetting them costs time only.
KEPT, KEPT_LENGTH = 200_000, 8 << 20


class Entries:
    """The pieces (id, token, start, end) of segments met so far, as flat arrays."""

    def __init__(self):
        self.number: dict = {}
        self.length = 0
        self.count, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = [np.zeros(0, np.int32) for _ in range(4)]
        self.token_number: dict[str, int] = {}
        self.tokens = pa.array([], pa.string())
        self.margin = np.zeros(0)

    def add(self, keys: list, parts: list[Sequence[tuple[int, str, int, int]]]) -> None:
        for key in keys:
            self.number[key] = len(self.number)
            text = key if isinstance(key, str) else key[0]
            self.length += len(text) if isinstance(text, str) else 1
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begin = np.concatenate([self.begin, len(self.flat[0]) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.margin = np.concatenate([self.margin, [getattr(part, "margin", np.inf) for part in parts]])
        pieces = [p for part in parts for p in part]
        number = self.token_number
        for p in pieces:
            number.setdefault(p[1], len(number))
        columns = ([p[0] for p in pieces], [number[p[1]] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces])
        self.flat = [np.concatenate([old, np.array(new, np.int32)]) for old, new in zip(self.flat, columns, strict=True)]
        if len(number) > len(self.tokens):
            self.tokens = pa.array(list(number), pa.string())


def entries_of(model, keys: list, part, many=None) -> tuple[Entries, np.ndarray]:
    """The entries that hold what ``part`` (``many``: of a list) gives for these distinct keys, and the keys' numbers."""
    known = model.__dict__.get("_entries")
    if known is None or len(known.number) > KEPT or known.length > KEPT_LENGTH:
        known = model.__dict__["_entries"] = Entries()
    new = [k for k in keys if k not in known.number]
    if new:
        known.add(new, many(new) if many else [part(k) for k in new])
    return known, np.fromiter(map(known.number.__getitem__, keys), np.int64, len(keys))


def gathered(entries: Entries, entry: np.ndarray, offset: np.ndarray, base: np.ndarray | None, words: pa.Array | np.ndarray, first: np.ndarray, lost: np.ndarray, limit: int | None) -> pa.StructArray:
    """The struct of pieces of each text: text d has the segments first[d]:first[d + 1], whose
    pieces are moved by the segment's offset (0 at least) and then by its base."""
    count = entries.count[entry]
    ends = np.concatenate([[0], np.cumsum(count)])
    segment = np.repeat(np.arange(len(entry)), count)
    at = np.arange(ends[-1]) - ends[:-1][segment] + entries.begin[entry][segment]
    rows = ends[first]
    if limit is not None:
        within = np.arange(ends[-1]) - np.repeat(rows[:-1], np.diff(rows)) < limit
        segment, at = segment[within], at[within]
        rows = np.concatenate([[0], np.cumsum(np.minimum(np.diff(rows), limit))])
    ids, token, starts, stops = entries.flat
    start, end = (np.maximum(0, x[at] + offset[segment]) for x in (starts, stops))
    if base is not None:
        start, end = start + base[segment], end + base[segment]
    spots = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
    word = words.take(pa.array(segment)) if isinstance(words, pa.Array) else pa.array(words[segment], pa.int32())
    edges, mask = pa.array(rows, pa.int32()), pa.array(lost)
    values = (pa.array(ids[at]), entries.tokens.take(pa.array(token[at])), spots, word)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(edges, x, mask=mask) for x in values], names=PIECES.names)


def blank(points: np.ndarray) -> np.ndarray:
    """Which characters are white space."""
    return _BLANK[np.minimum(points, len(_BLANK) - 1)]


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a column with at most ``limit`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, stop
        at = stop


def only(pieces: pa.StructArray, wanted: tuple) -> pa.StructArray:
    """The pieces with null in place of fields that aren't wanted."""
    fields = [x if t.name in wanted else pa.nulls(len(pieces), t.type) for x, t in zip(pieces.flatten(), pieces.type, strict=True)]
    return pa.StructArray.from_arrays(fields, names=PIECES.names)


def struct_of(edges: pa.Array, mask: pa.Array, fields: dict[str, pa.Array]) -> pa.StructArray:
    """Pieces of these fields, as lists with these edges; null in place of the others."""
    lists = [pa.ListArray.from_arrays(edges, fields[n], mask=mask) if n in fields else pa.nulls(len(mask), t) for n, t in _TYPES]
    return pa.StructArray.from_arrays(lists, names=PIECES.names)


def surrounded(ids: pa.ListArray, front: list[int], back: list[int]) -> pa.ListArray:
    """Lists of ids with these before and behind each."""
    if not front and not back:
        return ids
    first, flat, lost = flattened(ids, ids)
    edges = np.concatenate([[0], np.cumsum(np.where(lost, 0, np.diff(first) + len(front) + len(back)))])
    made, whole = np.empty(edges[-1], np.int32), np.flatnonzero(~lost)
    inner = np.ones(len(made), bool)
    for k, x in enumerate(front):
        made[edges[whole] + k], inner[edges[whole] + k] = x, False
    for k, x in enumerate(reversed(back), 1):
        made[edges[whole + 1] - k], inner[edges[whole + 1] - k] = x, False
    made[inner] = flat.to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(made), mask=pa.array(lost))


#: Rows that a worker hands on at a time.
ROWS = 1 << 15


def exploded(keys: list[pa.Array], lists: pa.ListArray, columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row an element of the lists: the keys of its list, its place there, and the columns."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), size)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    for i in range(0, len(row), ROWS):
        part = pa.array(row[i : i + ROWS])
        yield pa.record_batch([*(k.take(part) for k in keys), pa.array(pos[i : i + ROWS]), *(c[i : i + ROWS] for c in columns)], names=names)


def mapped(df, fn, schema):
    """``df`` by batches: ``fn`` gives those made of one; freed memory goes back when a task ends."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            yield from fn(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def joined(parts: list[pa.StructArray]) -> pa.StructArray:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([pa.field(n, t) for n, t in _TYPES]))


_SPOT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TYPES = [("ids", pa.list_(pa.int32())), ("tokens", pa.list_(pa.string())), ("offsets", pa.list_(_SPOT)), ("words", pa.list_(pa.int32()))]


def code_points(col: pa.Array) -> np.ndarray:
    """The characters of all texts of a column."""
    if not len(col):
        return np.zeros(0, np.uint32)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    text = bytes(memoryview(data)[off[0] : off[-1]]).decode() if data is not None else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def places(texts: pa.Array, segments: pa.Array, first: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Where each segment stands in its text: each is the first of its kind behind the one
    before. Where segments are the whole text, or all of it that isn't white space, that is a
    matter of counting; only the other texts are searched."""
    size = lengths(segments)
    done = np.concatenate([[0], np.cumsum(size)])
    points, given = code_points(texts), code_points(segments)
    begin = np.concatenate([[0], np.cumsum(lengths(texts))])
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    out, left, held = np.zeros(len(segments), np.int64), ~lost, np.diff(done[first])
    left[np.unique(text[size == 0])] = False  # empty segments leave no trace
    searched = ~left & ~lost
    for flags in (lambda: np.ones(len(points), bool), lambda: ~blank(points)):
        if not left.any():
            break
        kept = flags()
        seen = np.diff(np.concatenate([[0], np.cumsum(kept)])[begin])
        alike = left & (held == seen)  # as many characters
        if not alike.any():
            continue
        own, theirs = np.flatnonzero(kept)[np.repeat(alike, seen)], np.flatnonzero(np.repeat(alike, held))
        alike[np.repeat(np.flatnonzero(alike), seen[alike])[points[own] != given[theirs]]] = False
        spot = np.zeros(len(given), np.int64)
        spot[theirs] = own
        some = np.flatnonzero(alike[text])
        torn = spot[done[some + 1] - 1] - spot[done[some]] != size[some] - 1
        alike[text[some[torn]]] = False
        some = some[alike[text[some]]]
        out[some] = spot[done[some]] - begin[text[some]]
        left &= ~alike
    for d in np.flatnonzero(left | searched).tolist():
        t, at = texts[d].as_py(), 0
        for i in range(first[d], first[d + 1]):
            s = segments[i].as_py()
            at = out[i] = t.find(s, at)
            at += len(s)
    return out


def lengths(col: pa.Array) -> np.ndarray:
    """The lengths of texts in characters, 0 for null."""
    return pc.fill_null(pc.utf8_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flattened(texts: pa.Array, segments: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where each text's segments begin (and len + 1), the segments of all, and which texts
    have none because they or their segments are null."""
    lost = np.logical_or(texts.is_null().to_numpy(zero_copy_only=False), segments.is_null().to_numpy(zero_copy_only=False))
    if lost.any():
        segments = pc.if_else(pa.array(lost), pa.scalar([], segments.type), segments)
    first = np.concatenate([[0], np.cumsum(segments.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return first, segments.flatten(), lost


def encode_words(model, texts: pa.Array, segments: pa.Array, limit: int | None, placed: bool = True) -> pa.StructArray:
    """Pieces of segments given as lists; ``model.word`` encodes one. Unless ``placed``, offsets are
    those within segments."""
    first, flat, lost = flattened(texts, segments)
    distinct = flat.dictionary_encode()
    entries, numbers = entries_of(model, distinct.dictionary.to_pylist(), getattr(model, "fresh", model.word))
    entry = numbers[distinct.indices.to_numpy(zero_copy_only=False)]
    number = np.arange(len(entry)) - np.repeat(first[:-1], np.diff(first))
    where = places(texts, flat, first, lost) if placed else np.zeros(len(entry), np.int64)
    return gathered(entries, entry, where, None, number, first, lost, limit)


def encode_texts(model, texts: pa.Array, limit: int | None) -> pa.StructArray:
    """Pieces of texts that ``model.cut`` takes apart, as (key, offset, base, word or None),
    and whose parts ``model.part`` encodes."""
    number: dict = {}
    entry: list[int] = []
    where: list[tuple[int, int, int | None]] = []
    first = [0]
    for text in texts.to_pylist():
        for key, *spot in model.cut(text) if text is not None else ():
            entry.append(number.setdefault(key, len(number)))
            where.append(spot)
        first.append(len(entry))
    offset, base, word = zip(*where, strict=True) if where else ((), (), ())
    lost = texts.is_null().to_numpy(zero_copy_only=False)
    entries, numbers = entries_of(model, list(number), model.part, getattr(model, "parts", None))
    return gathered(entries, numbers[np.array(entry, np.int64)], np.array(offset, np.int64), np.array(base, np.int64), pa.array(word, pa.int32()), np.array(first), lost, limit)
