"""Byte-pair encoding by the ranks of byte strings, with specials that are always recognised."""

from __future__ import annotations

import numpy as np
import regex

from tokenloom.kernels.merging import Pairs, byte_symbols, merge
from tokenloom.kernels.pieces import Piece, placed, text_elements


class ByteRank:
    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int]):
        self.ranks, self.specials = ranks, specials
        self.pattern = regex.compile(pattern)
        order = sorted(specials, key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(map(regex.escape, order))) if order else None
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.special_of = {i: s for s, i in specials.items()}
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def segments(self, text: str) -> list[tuple[str, int, bool]]:
        """(part, offset, whether special). A match before a special is bounded by where it
        starts only, so it may run on into the special's own text."""
        out, at = [], 0
        marks = [m.span() for m in self.special.finditer(text)] if self.special else []
        for a, b in [*marks, (len(text), len(text))]:
            for m in self.pattern.finditer(text, at):
                if m.start() >= a:
                    break
                if m[0]:
                    out.append((m[0], m.start(), False))
            if a < b:
                out.append((text[a:b], a, True))
            at = b
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of one part; offsets are those of the text elements."""
        found = self.known.get(text)
        if found is None:
            owner, at = [], 0
            for e in text_elements(text):
                owner += [(at, at + len(e))] * len(e.encode())
                at += len(e)
            data = text.encode()
            if data in self.ranks:
                found = [(self.ranks[data], 0, len(text))]
            else:
                rank = lambda a, b: (self.ranks[a + b], a + b) if a + b in self.ranks else None
                merged = merge([data[i : i + 1] for i in range(len(data))], rank)
                found = [(self.ranks[s], owner[i][0], owner[j - 1][1]) for s, i, j in merged]
            if len(text) < 64:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[text] = found
        return found

    def cut(self, text: str) -> list[tuple[tuple[str, bool], int, int, int]]:
        return [((part, special), offset, 0, n) for n, (part, offset, special) in enumerate(self.segments(text))]

    def part(self, key: tuple[str, bool]) -> list[tuple[int, str, int, int]]:
        text, special = key
        if special:
            return [(self.specials[text], text, 0, len(text))]
        return [(i, self.bytes_of[i].decode(errors="replace"), a, b) for i, a, b in self.spans(text)]

    def parts(self, keys: list[tuple[str, bool]]) -> list[list[tuple[int, str, int, int]]]:
        """``part`` of many keys; texts that are no token themselves are merged together."""
        plain = [t for t, special in keys if not special and t.encode() not in self.ranks]
        if not all(bytes([b]) in self.ranks for b in range(256)):
            return [self.part(k) for k in keys]
        if "_pairs" not in self.__dict__:
            cuts = ((b, r, k) for b, r in self.ranks.items() for k in range(1, len(b)))
            self._pairs = Pairs({(self.ranks[b[:k]], self.ranks[b[k:]]): (r, r) for b, r, k in cuts if b[:k] in self.ranks and b[k:] in self.ranks})
            self._first = np.array([self.ranks[bytes([b])] for b in range(256)])
        made = dict(zip(plain, byte_symbols(plain, self._pairs, self._first, lambda i: (i, self.bytes_of[i].decode(errors="replace")), lambda t: self.part((t, False))), strict=True))
        return [made[k[0]] if not k[1] and k[0] in made else self.part(k) for k in keys]

    def encode(self, text: str, limit: int | None = None) -> list[Piece]:
        return placed(self, text, limit)

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        out, run = [], []
        for i in ids:
            if i in self.special_of:
                out.append(b"".join(run).decode(errors="replace"))
                run = []
                out += [] if skip_special else [self.special_of[i]]
            else:
                run.append(self.bytes_of.get(i, b""))
        return "".join([*out, b"".join(run).decode(errors="replace")])
