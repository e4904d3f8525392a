"""Operator 5, approximate nearest neighbours by a permutation index.

A bounded sample of vectors are pivots; their number grows with the square root of the table.
Every vector is represented by its nearest pivots in order, and posted under each of them with
the pivot's place in that order. A query walks the lists of its own nearest pivots; the
footrule distance of the two orders (pivots outside an order count as just behind it) falls
out of the shared pivots alone. A list's length over that of the table falls with the number
of pivots, so what a query walks grows with the square root of the table, and so does the
number of vectors ranked again by their exact inner products: all those within a footrule
bound, which a sample sets for each query. Largest inner products become smallest angles by
one more coordinate that makes all vectors equally long.

Equal vectors are one entry with their smallest ids, and equal queries are searched once.
Entries lie in blocks of a bounded size, each with posting lists of its own: the cells of
some of the pivots, large cells split. A directory tells under which pivots a block has
postings; a query visits only the blocks that have some under its first pivots.

Defined results: vectors that are null, empty, zero, hold nulls or non-finite components, or
are of another dimension than most rows (of equals the smaller) take no part, nor do rows with a
null id; rows with equal ids and vectors count once; equal ids with different vectors are
separate candidates and queries; ties of scores go to the smaller id; an empty table gives an
empty result; other columns are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import map_batches, materialize
from tokenloom.session import ship

#: The index: PIVOTS times the root of the number of vectors are pivots (so many at most), and
#: so many of a vector's order are kept.
PIVOTS, MOST_PIVOTS = 4, 4096
ORDER = 64
#: Ranked again are about RERANK times the root of the number of vectors, by the footrule
#: bound that this many sampled vectors give; with no more vectors than FLOOR all are.
RERANK = 16
SAMPLE = 4096
FLOOR = 1024
#: Pivots of a query that lead it to blocks, and bytes of vectors in a block or part of queries.
LEADING = 4
BLOCK_BYTES = 4 << 20

INDEX = "block int, vid long, v array<double>, ids array<long>, perm array<int>"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles; rows may repeat."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    found = rows.where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    sizes = found.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return found.where(F.size("v") == (sizes[0]["dim"] if sizes else 0))


def lengthened(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings them all to the length ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (v**2).sum(axis=1)))
    return np.column_stack([v, rest])


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])]
    return np.concatenate(parts).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Pivots:
    """Sampled vectors, all of the length 1, by whose nearness vectors are ordered."""

    def __init__(self, v: np.ndarray, longest: float, order: int = ORDER):
        self.longest, self.order = longest, min(order, len(v))
        self.axes = lengthened(v, longest)
        self.axes /= np.linalg.norm(self.axes, axis=1, keepdims=True)

    def orders(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """The numbers of the nearest pivots of each vector, nearest first, ties to the smaller."""
        far = -(np.column_stack([v, np.zeros(len(v))] if query else [lengthened(v, self.longest)]) @ self.axes.T)
        if self.order < far.shape[1]:
            near = np.sort(np.argpartition(far, self.order - 1, axis=1)[:, : self.order], axis=1)
        else:
            near = np.tile(np.arange(far.shape[1]), (len(far), 1))
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)


class PostingLists:
    """The posting lists of some vectors, given by their orders."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.size, self.order = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = by_pivot // max(1, self.order)
        self.left = (self.order - by_pivot % max(1, self.order)).astype(float)  # places from the end
        self.begin = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """For each vector the sum, over pivots it shares with the order, of how far the later
        of the two places is from the end: the footrule distance is a constant less twice it."""
        lists = [slice(self.begin[p], self.begin[p + 1]) for p in order.tolist()]
        weight = [np.minimum(self.left[x], self.order - i) for i, x in enumerate(lists)]
        return np.bincount(np.concatenate([self.rows[x] for x in lists]), np.concatenate(weight), minlength=self.size)


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v * q).sum(axis=1)


HITS = pa.schema([("query", pa.int64()), ("vid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def _searcher(n_pivots: int, k: int):
    """Searches one block with the queries that visit it: of each the k best vectors within
    its bound."""

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return HITS.empty_table()
        vectors = vectors.sort_by("first")
        v, vid, lists = matrix(vectors["v"]), vectors["vid"].to_numpy(), PostingLists(matrix(vectors["perm"]), n_pivots)
        out: list[list] = [[], [], []]
        rows = []
        for query, q, order, bound in zip(queries["query"].to_pylist(), matrix(queries["v"]), matrix(queries["perm"]), queries["bound"].to_numpy(), strict=True):
            near = np.flatnonzero(lists.shared(order) >= bound)
            score = exact(v[near], q)
            if len(near) > k:
                some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                near, score = near[some], score[some]
            best = np.argsort(-score, kind="stable")[:k]  # rows ascend by their smallest id
            rows.append(near[best])
            out[0].append(np.full(len(best), query, np.int64))
            out[1].append(score[best])
        at = np.concatenate(rows)
        ids = vectors["ids"].combine_chunks()
        return pa.table([pa.array(np.concatenate(out[0])), pa.array(vid[at]), pa.array(np.concatenate(out[1])), ids.take(pa.array(at))], schema=HITS)

    return search


def build_index(vectors: DataFrame, order: int = ORDER) -> tuple[DataFrame, Pivots, np.ndarray]:
    """The index (block, vid, v, ids, perm) of the entries (vid, v, ids), which are not empty
    and of one dimension; the pivots; and the orders of the sample that sets bounds."""
    n, longest2, dim = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.size("v"))).first()
    n_pivots = min(n, MOST_PIVOTS, max(64, int(PIVOTS * n**0.5)))
    # the bound on the sample: MOST_PIVOTS and SAMPLE rows, chosen by a hash
    drawn = vectors.orderBy(F.xxhash64("vid"), "vid").limit(n_pivots + SAMPLE).select("v").collect()
    drawn = np.array([r["v"] for r in drawn])
    pivots = Pivots(drawn[:n_pivots], float(np.sqrt(longest2)), order)
    block_rows = max(256, BLOCK_BYTES // (8 * dim))
    cells = max(1, min(n_pivots, n // block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            if not len(v):
                continue
            perm = pivots.orders(v)
            cell = (lengthened(v, pivots.longest) @ pivots.axes[:cells].T).argmax(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns, lists], names=["block", "vid", "v", "ids", "perm"])

    placed = materialize(map_batches(vectors.select("vid", "v", "ids"), run, INDEX), "placed")
    sizes = placed.groupBy("block").agg(F.count("*").alias("size"))  # a row for each cell, of which there are MOST_PIVOTS at most
    part = F.pmod(F.xxhash64("vid"), F.ceil(F.col("size") / block_rows)).cast("int")
    index = placed.join(F.broadcast(sizes), "block").select((F.col("block") + F.lit(cells) * part).alias("block"), "vid", "v", "ids", "perm")
    return index, pivots, pivots.orders(drawn[n_pivots:]) if n > FLOOR and len(drawn) > n_pivots else np.zeros((0, 0), np.int64)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots under which each block has postings, once for each batch."""
    for batch in batches:
        perm = matrix(batch.column(1))
        if len(perm):
            pairs = np.unique(np.repeat(batch.column(0).to_numpy().astype(np.int64), perm.shape[1]) << 32 | perm.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32())], names=["block", "pivot"])


def bounded(pivots: Pivots, sample: np.ndarray, n: int, queries: DataFrame) -> DataFrame:
    """query, v, perm and the queries' bounds on what orders share: those that the sample says
    about RERANK times the root of n vectors reach; 0 without a sample."""
    rank = max(8, -(-int(RERANK * len(sample)) // max(1, int(n**0.5))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = PostingLists(sample, len(pivots.axes)) if len(sample) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            perm = pivots.orders(matrix(batch.column(1)), query=True)
            bound = [max(1.0, np.partition(lists.shared(o), len(sample) - rank)[len(sample) - rank]) if lists else 0.0 for o in perm]
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, pa.array(bound)], names=["query", "v", "perm", "bound"])

    return map_batches(queries.select("query", "v"), run, "query long, v array<double>, perm array<int>, bound double")


def visit(index: DataFrame, n_pivots: int, dim: int, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query, vid, score, ids: the k best entries within their bounds that the queries find in
    the blocks they visit (query, block)."""
    per_part = max(256, BLOCK_BYTES // (8 * dim))
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    left = index.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vid", "v", "ids", "perm", F.col("ids")[0].alias("first"))
    dealt = visits.join(parts, "block").select("block", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"), "query")
    right = dealt.join(asked, "query").select("block", "part", "query", "v", "perm", "bound")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_searcher(n_pivots, k), "query long, vid long, score double, ids array<long>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def merged(found: DataFrame, k: int) -> DataFrame:
    """query, hits: the k nearest rows (far, vec_id, vid) of each query."""
    rows = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), F.col("vid")))))
    return found.groupBy("query").agg(F.slice(F.array_sort(rows), 1, k).alias("hits"))


def search(index: DataFrame, pivots: Pivots, sample: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """query, hits: the k nearest rows found for each of the vectors (query, v)."""
    n, last, dim = index.agg(F.count("*"), F.max("block"), F.max(F.size("v"))).first()
    asked = materialize(bounded(pivots, sample, n, queries), "asked")
    directory = map_batches(index.select("block", "perm"), _posted, "block int, pivot int").distinct()
    led = asked.select("query", F.explode(F.slice("perm", 1, LEADING)).alias("pivot"))
    visits = materialize(led.join(directory, "pivot").select("query", "block").distinct(), "visits")
    hits = materialize(merged(visit(index, len(pivots.axes), dim, asked, visits, k), k), "hits")
    # a query that found fewer than k is searched again in all blocks without a bound
    short = asked.join(hits.where(F.size("hits") >= k), "query", "left_anti").withColumn("bound", F.lit(0.0))
    if n <= 1 or short.isEmpty():
        return hits
    everywhere = short.select("query", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    return hits.where(F.size("hits") >= k).unionByName(merged(visit(index, len(pivots.axes), dim, short, everywhere, k), k))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, order: int = ORDER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own row left out.
    Both tables have vec_id and v, as ``usable`` gives them."""
    spark = vectors.sparkSession
    ship(spark)
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("vid", F.monotonically_increasing_id()), "entries")
    if entries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, pivots, sample = build_index(entries, order)
    queries = materialize(queries.distinct(), "query-rows")
    asked = materialize(queries.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    hits = search(index, pivots, sample, asked, k + 1)
    own = queries.join(asked, "v").join(entries.select("v", "vid"), "v", "left").select(F.col("vec_id").alias("query_id"), "query", "vid")
    others = own.join(hits, "query").select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: ~(h["vec_id"].eqNullSafe(F.col("query_id")) & h["vid"].eqNullSafe(F.col("vid")))), 1, k)).alias("at", "h"))
    return others.select("query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", (-F.col("h.far")).alias("score"))


def self_search(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Searches with every row whose id is divisible by ``every``, against all rows."""
    vectors = usable(rows)
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % every == 0), k)
