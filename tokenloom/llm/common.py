"""What the operators share: bounded Arrow batches, shared folders, and vectorised
segmentation and hashing of the words of a whole batch of texts."""

from __future__ import annotations

import atexit
import ctypes
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import ship

#: Rows and bytes that one Arrow batch brings to a Python worker at most (a single longer
#: text still travels whole).
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (in
    local runs, where it is unset) a temporary folder that is then put there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that isn't there yet; what is written to it goes when the
    driver ends, if ``discard`` hasn't removed it before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the lineage is cut
    and every later use reads the same rows, whichever executors are lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes what ``materialize`` wrote; for intermediates that no frame given out reads."""
    for df in written:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    _MADE.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM has ended before
            return


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches, so that memory doesn't grow with text lengths. The
    session's batch settings are read when a plan runs, so they are put there and stay, but
    only where they are unset: a caller's own settings hold."""
    spark = df.sparkSession
    ship(spark)
    given = spark.conf.getAll
    for key, value in _BATCHES.items():
        if key not in given:
            spark.conf.set(key, str(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, made once in a worker. Only the last one asked for is kept, so a
    worker that serves several stages holds the tables and caches of one."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1])) if len(col) else np.zeros(0)
    at = 0
    while at < len(col):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or of binary values, nulls as empty, and its len + 1
    offsets from 0."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the public splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as numbers; zeros behind its end."""
    padded = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the runs data[starts[i]:starts[i] + lengths[i]], eight bytes a step.
    Each step is a bijection of its eight bytes, so runs of the same length and hash that
    agree in all steps but the last are equal."""
    size = data.dtype.itemsize
    at, left = starts * size, lengths * size
    every = lanes(data)
    out = splitmix(left.astype(np.uint64) ^ np.uint64(salt))
    on = None
    while True:
        lane = every[at] & _KEEP[np.minimum(left, 8)]
        if on is None:
            out = splitmix(out ^ lane)
        else:
            out[on] = splitmix(out[on] ^ lane)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        on = more if on is None else on[more]
        at, left = at[more] + 8, left[more] - 8


def lookup(table: dict[int, int], default: int | None = None) -> bytes:
    """A table for bytes.translate: the given bytes, the others to ``default`` or themselves."""
    return bytes(table.get(b, b if default is None else default) for b in range(256))


#: Words: digits, a-z and everything outside ASCII, after A-Z are lower-cased; else a space.
_WORD = lookup({**{b: b for b in (*range(48, 58), *range(97, 123), *range(128, 256))}, **{b: b + 32 for b in range(65, 91)}}, 32)


def latin_capitals(raw: np.ndarray) -> np.ndarray:
    """Places of the second bytes of Latin-1's capitals in UTF-8."""
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = raw[at]
    return at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]


class Words:
    """All words of a batch of texts: word i is data[starts[i]:starts[i] + lengths[i]], text
    d has the words first[d]:first[d + 1] and the bytes off[d]:off[d + 1]. Outside words
    ``data`` has spaces. With ``latin``, Latin-1's capitals are lower-cased as ASCII's are."""

    def __init__(self, col: pa.Array, latin: bool = False):
        raw, self.off = utf8(col)
        data = np.frombuffer(raw.tobytes().translate(_WORD), np.uint8)
        if latin and len(raw):
            data = data.copy()
            data[latin_capitals(raw)] += 32
        inside = data != 32
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.off] = True
        at = np.flatnonzero(edge[:-1])
        lengths = np.diff(at, append=len(data))
        kept = inside[at] if len(at) else np.zeros(0, bool)
        self.data, self.starts, self.lengths = data, at[kept], lengths[kept]
        self.first = np.searchsorted(self.starts, self.off)
        self.hashes = run_hashes(data, self.starts, self.lengths) if len(data) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


class HashIndex:
    """An open-addressing map from 64-bit hashes to entry numbers in NumPy."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.keys, self.vals = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none. The hash 0 counts as 1."""
        h = np.where(h == 0, np.uint64(1), h)
        slot = self._slot(h)
        key = self.keys[slot]
        out = np.where(key == h, self.vals[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, new: np.ndarray) -> None:
        """Puts entry numbers in for hashes that are distinct and not yet there."""
        h, new = np.where(h == 0, np.uint64(1), h), new.astype(np.int32)
        keep = np.append(h[1:] != h[:-1], True)  # 0 and 1 may both be among them
        h, new = h[keep], new[keep]
        self.n += len(h)
        if self.n * 2 > len(self.keys):
            full = self.keys != 0
            old_k, old_v = self.keys[full], self.vals[full]
            self._clear(int(self.n * 4).bit_length())
            self._place(old_k, old_v)
        self._place(h, new)

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        slot, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]
            won = left[free][self.keys[slot[left[free]]] == h[left[free]]]
            self.vals[slot[won]] = v[won]
            done = np.zeros(len(h), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class Pool:
    """Variable-length arrays of one type, back to back, by entry number."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.off, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = 0

    def extend(self, items: list) -> None:
        """Appends items: sequences, or bytes for a pool of bytes."""
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        if self.flat.dtype == np.uint8:
            new = np.frombuffer(b"".join(items), np.uint8)
        else:
            new = np.fromiter(chain.from_iterable(items), self.flat.dtype, int(sizes.sum()))
        while self.used + len(new) + 8 > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(items) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.flat[self.used : self.used + len(new)] = new
        self.off[self.n : self.n + len(items)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(items) else 0
        self.len[self.n : self.n + len(items)] = sizes
        self.used, self.n = self.used + len(new), self.n + len(items)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these entries back to back, and the len + 1 offsets of each."""
        return ragged(self.flat, self.off[entries], self.len[entries])


def ragged(flat: np.ndarray, off: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[off[i]:off[i] + length[i]] for all i, back to back, and len + 1 offsets."""
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return flat[np.repeat(off - ends[:-1], length) + np.arange(ends[-1])], ends


class Memo:
    """Remembers what a function of a run of bytes (or code points) returned: only runs not
    seen before reach ``compute``, which gets a list of runs. Runs are found by a hash that
    is salted in each worker, and every hit is compared with the remembered run itself; a run
    that only shares another's hash is computed anew. Entries are dropped all together beyond
    ``limit`` of them or ``limit_bytes``; that costs time only."""

    def __init__(self, compute: Callable[[list], tuple[list, ...]], dtypes: tuple, limit: int = 800_000, limit_bytes: int = 96 << 20):
        self.compute, self.dtypes, self.limit, self.limit_bytes = compute, dtypes, limit, limit_bytes
        self.salt = secrets.randbits(64)
        self._reset()

    def _reset(self) -> None:
        self.index, self.runs, self.pools = HashIndex(), Pool(np.uint8), [Pool(t) for t in self.dtypes]

    def _learn(self, runs: list[bytes]) -> np.ndarray:
        """Numbers of new entries."""
        first = self.runs.n
        for pool, items in zip(self.pools, self.compute(runs), strict=True):
            pool.extend(items)
        self.runs.extend(runs)
        return np.arange(first, self.runs.n)

    def entries(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each run, which indexes every pool."""
        if self.runs.n > self.limit or sum(p.flat.nbytes for p in (self.runs, *self.pools)) > self.limit_bytes:
            self._reset()
        begin, size = starts * data.dtype.itemsize, lengths * data.dtype.itemsize
        raw = data.view(np.uint8)
        cut = lambda at: [raw[i:j].tobytes() for i, j in zip(begin[at].tolist(), (begin[at] + size[at]).tolist(), strict=True)]
        hashes = run_hashes(raw, begin, size, self.salt)
        found = self.index.get(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            self.index.add(new, self._learn(cut(missing[at])))
            found[missing] = self.index.get(hashes[missing])
        other = np.flatnonzero(self._differing(raw, begin, size, found) | (hashes < 2))  # the index has 0 as 1
        if len(other):  # these stay outside the index
            runs = cut(other)
            distinct = list(dict.fromkeys(runs))
            number = dict(zip(distinct, self._learn(distinct).tolist(), strict=True))
            found[other] = [number[r] for r in runs]
        return found

    def _differing(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether a run's entry is that of another run of the same hash."""
        wrong = self.runs.len[found] != size
        on = np.flatnonzero((size > 8) & ~wrong)
        if len(on):
            mine, known = lanes(raw), np.ndarray((len(self.runs.flat) - 7,), "<u8", self.runs.flat, strides=(1,))
            at, there, left = begin[on], self.runs.off[found[on]], size[on]
            while len(on):
                wrong[on[mine[at] != known[there]]] = True
                more = left > 16
                on, at, there, left = on[more], at[more] + 8, there[more] + 8, left[more] - 8
        return wrong
