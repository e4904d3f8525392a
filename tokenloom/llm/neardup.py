"""Operator 10, near-duplicate documents by DartMinHash.

A document is a set of five-word shingles, each weighing its count in the document (or 1, with
``weighted=False``). Every shingle owns an unending sequence of darts, hashed from itself
alone: their ranks are the arrivals of a Poisson process whose rate is the region of weight
the darts fall into, and each dart falls on one coordinate of the signature. A document throws
the darts of its shingles up to a rank at which it has K ln K + 2 K of them, and keeps the
earliest of each coordinate (throwing on, to twice the rank, until none is empty). Two
documents agree on a coordinate with the probability of their weighted Jaccard similarity,
whatever their sizes.

Signatures are cut into bands; equal word sequences are one document beforehand. Documents
with a band in common are compared by their whole signatures, and those that may be similar
enough are connected into groups of candidates, which hold every link. Within a group, links
are those of the exact weighted similarity, and classes are the connected parts. Both steps
search along links, each document being compared with those not yet reached only, and both
work on parts of a bounded number of bytes: the parts of a larger group each hold a few seeds
as well, whose reach over all parts is known afterwards. Only members beyond the reach of the
group's best seed meet all others once more, part by part. So a group of mutual near copies
takes comparisons and rows in proportion to its size, and no link is lost in any group.

Defined results: a null text counts as empty; texts with equal words are one class whatever
their number, the empty ones too; texts of fewer than five words are one shingle, so only
equal ones meet; a class is named by its smallest doc_id (null ids last); equal and repeated
rows get the same class; an empty table gives an empty result; columns other than doc_id and
text are left alone, except in ``drop_copies``, which keeps all columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import Words, discard, map_batches, materialize, ragged, run_hashes, slices, splitmix

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of a signature, and those of a band: two documents of similarity 0.8 miss each
#: other in all 25 bands once in 20,000 times.
COORDINATES = 128
BAND = 5
BANDS = COORDINATES // BAND
#: Agreement of signatures below which a similarity of 0.8 is out of the question (over four
#: standard deviations of 128 coordinates).
HOPELESS = 0.64
#: Bytes of signatures, and of sets with them, that meet in one task (a single larger set still
#: travels whole), seeds that every part of a larger group holds, and hashes compared at once.
SIGNATURE_BYTES = 512 << 10
PART_BYTES = 2 << 20
SEEDS = 4
COMPARED = 1 << 18
#: What a member weighs beside its set: a signature and some.
MEMBER_BYTES = 512

_TERM = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``size`` words of all texts, and the len + 1 offsets. A
    shorter text is one run of all its words, an empty one has none. Words count as equal
    only if two unlike hashes of theirs are."""
    second = run_hashes(words.data, words.starts, words.lengths, int(_TERM[4])) if len(words.starts) else words.hashes
    mixed = splitmix(words.hashes + splitmix(second ^ _TERM[3]))
    n = np.diff(words.first)
    counts = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(n)), counts)
    at = words.first[:-1][text] + np.arange(ends[-1]) - ends[:-1][text]
    out = np.full(len(at), 0, np.uint64)
    for j in range(size):
        inside = at + j < words.first[1:][text]
        word = mixed[np.minimum(at + j, max(0, len(mixed) - 1))] if len(mixed) else np.zeros(len(at), np.uint64)
        out += np.where(inside, splitmix(word ^ _TERM[j % len(_TERM)]) * (_TERM[j % len(_TERM)] | np.uint64(1)), np.uint64(0))
    return splitmix(out), ends


def distinct(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, how often each stands there, and len + 1 offsets."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(at, append=len(h)), np.searchsorted(t[at], np.arange(len(ends)))


def counted(hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets whose similarity is that of the weighted ones: each element as often as it counts,
    the first as itself, ascending within a text; and len + 1 offsets."""
    before = np.concatenate([[0], np.cumsum(counts)])
    turn = np.arange(before[-1]) - np.repeat(before[:-1], counts)
    own = np.repeat(hashes, counts)
    out = np.where(turn, splitmix(own ^ splitmix(turn.astype(np.uint64))), own)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(before[ends]))
    return out[np.lexsort((out, text))], before[ends]


def dart_minhash(hashes: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Signatures (texts x k, 32 bits) of weighted sets: text d has the elements
    ends[d]:ends[d + 1]. Texts without elements have the signature 0."""
    n, none = len(ends) - 1, np.iinfo(np.uint64).max
    best = np.full(n * k, none, np.uint64)
    text = np.repeat(np.arange(n), np.diff(ends))
    total = np.bincount(text, weights, minlength=n)
    # the regions of weight [0, 1), [1, 2), [2, 4), ...: one process for each it reaches
    layers = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    row = np.repeat(np.arange(len(hashes)), layers)
    layer = np.arange(len(row)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    width, reach = np.maximum(1.0, low), weights[row] - low
    seed = splitmix(hashes[row] ^ splitmix(layer.astype(np.uint64)))
    limit = np.exp2(np.ceil(np.log2((k * np.log(k) + 2 * k) / np.maximum(total, 1e-9))))
    rank, owner = np.zeros(len(row)), text[row]

    def land(at: np.ndarray) -> None:
        """Puts the current darts of these processes on their coordinates."""
        y = splitmix(seed[at])
        inside = _unit(y) * width[at] < reach[at]
        at, y = at[inside], splitmix(y[inside])
        place = owner[at] * k + (y % np.uint64(k)).astype(np.int64)
        early = rank[at].astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, place, early << np.uint64(32) | y >> np.uint64(32))

    active, stopped = np.arange(len(row)), [np.zeros(0, np.int64)]
    open_ = np.flatnonzero(np.diff(ends) > 0)
    while True:
        while len(active):  # the next dart of every process that is still within its limit
            seed[active] = splitmix(seed[active] + np.uint64(0xD1342543DE82EF95))
            rank[active] -= np.log(_unit(seed[active])) / width[active]
            within = rank[active] < limit[owner[active]]
            stopped.append(active[~within])
            active = active[within]
            land(active)
        open_ = open_[(best.reshape(n, k)[open_] == none).any(axis=1)]
        if not len(open_):
            break
        limit[open_] *= 2
        halted = np.concatenate(stopped)
        within = rank[halted] < limit[owner[halted]]
        active, stopped = halted[within], [halted[~within]]
        land(active)
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)
    out[np.diff(ends) == 0] = 0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a 128-bit digest of each text's sequence of words, 0 for empty ones."""
    inside = words.data != 32
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one space behind a word
    text, ends = words.data[kept].tobytes(), np.concatenate([[0], np.cumsum(kept)])[words.off].tolist()
    found = [text[a:b].strip(b" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]
    both = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() if t else bytes(16) for t in found), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _text_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, the content's key (k1, k2), the signature, its bands and the size of the set, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column(1), latin=True)
                found, counts, ends = distinct(*shingles(words))
                sig = dart_minhash(found, counts.astype(float) if weighted else np.ones(len(found)), ends)
                bands = np.zeros((len(part), BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(len(part), b, np.uint64)
                    for j in range(BAND):
                        h = splitmix(h ^ splitmix(sig[:, b * BAND + j].astype(np.uint64)))
                    bands[:, b] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
                short = sig.astype(np.uint16)
                k1, k2 = keys(words)
                size = np.diff(ends) if not weighted else np.add.reduceat(np.append(counts, 0), ends[:-1]) * (np.diff(ends) > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1), pa.array(k2), pa.array([x.tobytes() for x in short], pa.binary()), lists, pa.array(size, pa.int64())], names=["doc_id", "k1", "k2", "sig", "bands", "size"])

    return map_batches(_text_columns(docs), run, "doc_id long, k1 long, k2 long, sig binary, bands array<long>, size long")


def agreeing(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Shares of equal coordinates of one signature with many."""
    return (others == sig).mean(axis=1)


def similar(x: int, others: np.ndarray, flat: np.ndarray, begin: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others' sets have this Jaccard similarity with x's, exactly. Set i is
    flat[begin[i]:begin[i + 1]], ascending."""
    own = flat[begin[x] : begin[x + 1]]
    sizes = begin[others + 1] - begin[others]
    if not len(own):
        return sizes == 0
    out = (np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own))) & (sizes > 0)
    left = np.flatnonzero(out)
    ends = np.cumsum(sizes[left])
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, side="right")))
        some = left[at:stop]
        values, edge = ragged(flat, begin[others[some]], sizes[some])
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(hit, edge[:-1], dtype=np.int64)
        out[some] = common >= similarity * (len(own) + sizes[some] - common)
        at = stop
    return out


def connected(sig: np.ndarray, links) -> np.ndarray:
    """For each member the first one that it is connected with. ``links(x, others)`` tells
    which others x is linked with; pairs that agree too little aren't asked for. A member
    that is reached is compared with those not yet reached only, so a group whose members
    are all alike takes one round of comparisons, however large it is."""
    root = np.arange(len(sig))
    left = np.arange(len(sig))
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            x = queue.pop()
            near = left[agreeing(sig[x], sig[left]) >= HOPELESS]
            found = near[links(x, near)] if len(near) else near
            if len(found):
                root[found] = seed
                queue += found.tolist()
                left = left[~np.isin(left, found, assume_unique=True)]
    return root


EDGES = "group long, a long, b long"


def _grouped(fn):
    """Runs ``fn`` over the groups of rows (group, x, y, first, cid, sig, ...) that come sorted
    by the first five; it gives each member's root, and the links (group, root, member) go
    out. One group is in memory at a time, beside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def work() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            root, own = fn(table), table.column(4).to_numpy()
            pairs = np.column_stack([own[root], own])
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key[0], np.int64)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["group", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(3)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.append(np.flatnonzero(new), batch.num_rows).tolist()
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                here = tuple(int(c[i]) for c in cols)
                if held and here != key:
                    yield work()
                key = here
                held.append(batch.slice(i, j - i))
        if held:
            yield work()

    return run


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint16).reshape(table.num_rows, COORDINATES)


def _resembling(table: pa.Table) -> np.ndarray:
    """Roots of members connected by signatures that agree enough."""
    return connected(_signatures(table), lambda x, others: np.ones(len(others), bool))


def _linked(similarity: float):
    """Roots of members connected by the exact similarity of their sets."""

    def run(table: pa.Table) -> np.ndarray:
        lists = table.column(6).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten().to_numpy().view(np.uint64)
        begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return connected(_signatures(table), lambda x, others: similar(x, others, flat, begin, similarity))

    return run


#: A key with more than one in so many rows is a hub; there are so many hubs at most.
HUB_SHARE = 500


def joined(rows: DataFrame, table: DataFrame, on: list[str], many: int) -> DataFrame:
    """Inner join with a table of one row a key, whose column n tells the key's rows (and is
    left out): keys with more than ``many`` are broadcast, so that their rows stay where they
    are. ``many`` is 1 / HUB_SHARE of all rows or more, which bounds what is broadcast."""
    hubs = F.broadcast(table.where(F.col("n") > many).drop("n"))
    rest = rows.join(hubs.select(*on), on, "left_anti").join(table.where(F.col("n") <= many).drop("n"), on)
    return rows.join(hubs, on).unionByName(rest)


def links_within(members: DataFrame, payload: DataFrame, fn, total: int, part_bytes: int) -> DataFrame:
    """Links (group, a, b) that connect, within each group, all members that ``fn`` links.
    ``members``, ``total`` rows, has group, cid and weight (bytes); ``payload`` has cid and
    what ``fn`` needs."""
    many = total // HUB_SHARE + 1
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).where("n > 1")

    def met(rows: DataFrame) -> DataFrame:
        """Links of what meets: rows (group, x, y, first, cid)."""
        dealt = rows.join(payload, "cid").select("group", "x", "y", "first", "cid", *[c for c in payload.columns if c != "cid"])
        return map_batches(dealt.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "first", "cid"), _grouped(fn), EDGES)

    zero = F.lit(0).alias
    small = met(members.join(sizes.where(F.col("bytes") <= part_bytes), "group").select("group", zero("x"), zero("y"), zero("first"), "cid"))
    large = materialize(sizes.where(F.col("bytes") > part_bytes), "large")
    if large.isEmpty():
        discard(large)
        return small
    at_large = materialize(joined(members, large.select("group", "n", "bytes"), ["group"], many), "at-large")
    # every part of a large group, with the group's seeds in front
    order = F.xxhash64("cid", F.lit(1))
    chosen = at_large.groupBy("group", F.pmod(order, F.lit(SEEDS)).alias("turn")).agg(F.min(F.struct(order.alias("order"), "cid")).alias("s"))
    seeds = materialize(chosen.select("group", F.col("s.cid").alias("cid")), "seeds")
    number = lambda bytes_, share: F.ceil(F.col(bytes_) / (part_bytes * share)).cast("int")
    deal = lambda parts: F.pmod(F.xxhash64("cid"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    others = at_large.join(seeds, ["group", "cid"], "left_anti").select("group", deal(number("bytes", 1.0)).alias("x"), zero("y"), F.lit(1).alias("first"), "cid")
    everywhere = seeds.join(large, "group").select("group", every(number("bytes", 1.0)).alias("x"), zero("y"), zero("first"), "cid")
    round1 = materialize(met(others.unionByName(everywhere)), "round")
    # members beyond the best seed's reach meet all of the group once more
    own = seeds.withColumnRenamed("cid", "a").join(large.select("group", "n"), "group")
    reach = joined(round1, own, ["group", "a"], many // SEEDS + 1).distinct()
    counts = reach.groupBy("group", "a").agg(F.count("*").alias("n"))
    best = counts.groupBy("group").agg(F.max(F.struct("n", "a")).alias("s")).select("group", F.col("s.a").alias("a"), F.col("s.n").alias("n"))
    reached = joined(reach, best, ["group", "a"], many).select("group", F.col("b").alias("cid")).union(best.select("group", "a"))
    beyond = materialize(at_large.join(reached, ["group", "cid"], "left_anti"), "beyond")
    if beyond.isEmpty():
        return small.unionByName(round1)
    rest = beyond.groupBy("group").agg(F.sum("weight").alias("rest")).join(large.select("group", "n"), "group")
    mine = joined(beyond, rest, ["group"], many).select("group", deal(number("rest", 0.5)).alias("x"), every(number("bytes", 0.5)).alias("y"), zero("first"), "cid")
    theirs = joined(at_large, rest, ["group"], many).select("group", every(number("rest", 0.5)).alias("x"), deal(number("bytes", 0.5)).alias("y"), F.lit(1).alias("first"), "cid")
    return small.unionByName(round1).unionByName(met(mine.unionByName(theirs)))


def candidate_groups(contents: DataFrame) -> DataFrame:
    """cid, group and weight of the contents (cid, sig, bands, size) that may be similar enough
    to another: every two such contents are in one group, as all those are that signatures
    connect."""
    posted = contents.select(F.explode("bands").alias("group"), "cid", F.lit(MEMBER_BYTES).alias("weight"))
    found = components(links_within(posted, contents.select("cid", "sig"), _resembling, BANDS * contents.count(), SIGNATURE_BYTES).select("a", "b"), "groups")
    members = found.select(F.col("node").alias("cid"), F.col("root").alias("group")).union(found.select("root", "root").distinct())
    out = materialize(members.join(contents.select("cid", (F.col("size") * 8 + MEMBER_BYTES).alias("weight")), "cid"), "near-groups")
    discard(found)
    return out


def _sets(texts: DataFrame, weighted: bool = True) -> DataFrame:
    """cid and the shingle set of the rows (k1, k2, cid, text) whose text has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column(3), latin=True)
                found, counts, ends = distinct(*shingles(words))
                if weighted:
                    found, ends = counted(found, counts, ends)
                k1, k2 = keys(words)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))
                own = (part.column(0).to_numpy() == k1) & (part.column(1).to_numpy() == k2)
                yield pa.RecordBatch.from_arrays([part.column(2), lists], names=["cid", "shingles"]).filter(pa.array(own))

    return map_batches(texts, run, "cid long, shingles array<long>").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def links(docs: DataFrame, contents: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """Pairs (a, b) of contents that connect all whose shingle sets have at least this
    weighted Jaccard similarity."""
    groups = candidate_groups(contents)
    wanted = groups.join(contents.select("cid", "k1", "k2", "rep"), "cid")
    some_id = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    texts = _text_columns(docs).withColumn("id", some_id(F.col("doc_id"))).join(wanted.withColumn("id", some_id(F.col("rep"))), "id")
    sets = _sets(texts.select("k1", "k2", "cid", F.coalesce("text", F.lit("")).alias("text")), weighted).join(contents.select("cid", "sig"), "cid")
    sets = materialize(sets.select("cid", "sig", "shingles"), "near-sets")
    out = materialize(links_within(groups, sets, _linked(similarity), groups.count(), PART_BYTES).select("a", "b"), "near-links")
    discard(sets, groups)
    return out


#: Turns after which something must be wrong: paths shrink by half or more in each.
TURNS = 200


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) is connected with.
    Large and small stars by turns: neighbours hang on the smallest one, until nothing moves.
    Nodes with many links, at most HUB_SHARE of them, are broadcast with their smallest
    neighbour, so that a hub's links are never gathered."""
    edges, before = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0"), None
    for turn in range(1, TURNS + 1):
        stats = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not stats[0] or stats == before:
            return _noted(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), edges)
        before, many = stats, 2 * stats[0] // HUB_SHARE + 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = joined(both.where("b > a"), low, ["a"], many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = materialize(large, f"{label}-large")
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(down, low, ["a"], many).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        made = materialize(small, f"{label}-{turn}")
        discard(edges, down)
        edges = made
    raise RuntimeError(f"links aren't connected after {TURNS} turns")


def _noted(df: DataFrame, written: DataFrame) -> DataFrame:
    df.written_to = written.written_to
    return df


def _classes(docs: DataFrame, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fingerprint rows (doc_id, k1, k2), and class_id by (k1, k2)."""
    prints = materialize(fingerprints(docs, weighted), "fingerprints")
    grouped = prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    contents = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "contents")
    near = links(docs, contents, weighted=weighted)
    found = components(near)
    joined = contents.select("cid", "k1", "k2", "rep").join(found, F.col("cid") == F.col("node"), "left")
    placed = joined.select("k1", "k2", "rep", F.coalesce("root", "cid").alias("root"))
    named = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = materialize(placed.join(named, "root").select("k1", "k2", "root", "class_id"), "classes")
    discard(contents, near, found)
    return prints.select("doc_id", "k1", "k2"), classes


def near_duplicates(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id and class_id of each row, by the similarity of shingle counts, or of their sets."""
    prints, classes = _classes(docs, weighted)
    return prints.join(classes, ["k1", "k2"]).select("doc_id", "class_id")


def drop_copies(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """``docs``, all columns, with one row of each class: that of the smallest doc_id."""
    prints, classes = _classes(docs, weighted)
    some_id = lambda c: F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1))
    rows = prints.groupBy(some_id("doc_id").alias("id"), "k1", "k2").agg(F.count("*").alias("rows")).join(classes, ["k1", "k2"])
    first = rows.groupBy("root").agg(F.min(F.struct("id", "k1", "k2", "rows")).alias("first"))
    taken = {c.lower() for c in docs.columns}
    id_, k1_, k2_ = on = [next(x for x in (n + "_" * i for i in range(99)) if x not in taken) for n in ("own_id", "own_k1", "own_k2")]
    keep = materialize(first.select(F.col("first.id").alias(id_), F.col("first.k1").alias(k1_), F.col("first.k2").alias(k2_), "first.rows"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                k1, k2 = keys(Words(part.column(part.schema.get_field_index("text")), latin=True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(k1), pa.array(k2)], names=[*part.schema.names, k1_, k2_])

    schema = T.StructType([*docs.schema.fields, T.StructField(k1_, T.LongType()), T.StructField(k2_, T.LongType())])
    keyed = map_batches(docs, run, schema).withColumn(id_, some_id("doc_id"))
    single = keyed.join(keep.where("rows = 1").drop("rows"), on, "left_semi").select(*docs.columns)
    repeated = keyed.join(keep.where("rows > 1").drop("rows"), on, "left_semi").groupBy(*on).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(repeated)
