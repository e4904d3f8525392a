"""Merging of neighbours by rank: lowest rank first, leftmost of equals."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from tokenloom.kernels.pieces import text_elements


def merge(symbols: list, rank: Callable[[object, object], tuple[int, object] | None]) -> list[tuple[object, int, int]]:
    """Merges ``symbols`` until no neighbours have a rank; gives each result with the first
    and last + 1 of the symbols in it. ``rank`` gives a pair's rank and merged symbol."""
    n = len(symbols)
    symbol, after, before = list(symbols), [*range(1, n + 1)], [*range(-1, n - 1)]
    heap: list[tuple[int, int, int, object, object, object]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := rank(symbol[i], symbol[j])) is not None:
            heapq.heappush(heap, (found[0], i, j, symbol[i], symbol[j], found[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and symbol[i] == a and symbol[j] == b):
            continue
        symbol[i], alive[j] = made, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append((symbol[i], i, after[i]))
        i = after[i]
    return out


class Pairs:
    """Ranks and results of pairs of numbered symbols, looked up by arrays."""

    def __init__(self, rules: dict[tuple[int, int], tuple[int, int]]):
        order = sorted(rules)
        self.keys = np.array([a << 32 | b for a, b in order], np.int64)
        self.rank = np.array([rules[x][0] for x in order], np.int64)
        self.made = np.array([rules[x][1] for x in order], np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 for those without a rank."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def merge_all(symbol: np.ndarray, row: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` of many rows of symbols at once (``row``: ascending), one merge a row in each
    round. The symbols left, in order, and the place of the first symbol in each."""
    place, kept = np.arange(len(symbol)), []
    while len(symbol):
        beside = np.flatnonzero(row[1:] == row[:-1])
        found = pairs.find(symbol[beside], symbol[beside + 1])
        beside, found = beside[found >= 0], found[found >= 0]
        # of each row's pairs, in order, the one of lowest rank, of equals the leftmost
        heads = np.flatnonzero(np.concatenate([[True], np.diff(row[beside]) > 0])) if len(beside) else beside
        best = np.minimum.reduceat(pairs.rank[found] << 32 | np.arange(len(beside)), heads) & (1 << 32) - 1 if len(beside) else beside
        at = beside[best]
        busy = np.zeros(int(row[-1]) + 1, bool)
        busy[row[at]] = True
        live = busy[row]
        kept.append((place[~live], symbol[~live]))
        symbol = symbol.copy()
        symbol[at] = pairs.made[found[best]]
        live[at + 1] = False
        symbol, row, place = symbol[live], row[live], place[live]
    places, symbols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*kept, strict=True) if kept else ((), ())))
    order = np.argsort(places, kind="stable")
    return symbols[order], places[order]


#: Texts with more bytes are merged one by one: each merge of one takes a round of all.
MERGED_TOGETHER = 64


def byte_symbols(texts: list[str], pairs: Pairs, first: np.ndarray, shown: Callable[[int], tuple[int, str]], part: Callable[[str], list]) -> list[list[tuple[int, str, int, int]]]:
    """(id, token, start, end) of texts whose symbols are bytes (``first``) at first; ``part``
    gives those of one text, for long ones and those with elements of several characters."""
    out: list = [None] * len(texts)
    own = []
    for k, t in enumerate(texts):
        if t and len(t.encode()) <= MERGED_TOGETHER and (t.isascii() and "\r" not in t or len(text_elements(t)) == len(t)):
            own.append(k)
        else:
            out[k] = part(t)
    if not own:
        return out
    points = np.frombuffer("".join(texts[k] for k in own).encode("utf-32-le"), np.uint32)
    length = np.array([len(texts[k]) for k in own])
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    within = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    row, spot = (np.repeat(x, size) for x in (np.repeat(np.arange(len(own)), length), within))
    data = np.frombuffer("".join(texts[k] for k in own).encode(), np.uint8)
    symbol, place = merge_all(first[data], row, pairs)
    last = np.concatenate([place[1:], [len(row)]]) - 1
    table = {s: shown(s) for s in np.unique(symbol).tolist()}
    pieces = [(*table[s], a, b) for s, a, b in zip(symbol.tolist(), spot[place].tolist(), (spot[last] + 1).tolist(), strict=True)]
    edges = np.searchsorted(row[place], np.arange(len(own) + 1)).tolist()
    for n, k in enumerate(own):
        out[k] = pieces[edges[n] : edges[n + 1]]
    return out
