"""Precompiled character maps: a double-array trie over UTF-8 bytes and a pool of
replacements, as SentencePiece models and tokenizer files carry them."""

from __future__ import annotations

import re
import struct
from functools import lru_cache


class CharsMap:
    def __init__(self, blob: bytes):
        if len(blob) < 4:
            raise ValueError("the character map is too short")
        size = struct.unpack_from("<I", blob)[0]
        if size > len(blob) - 4 or size % 4:
            raise ValueError("the character map's trie has a wrong size")
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.pool = blob[4 + size :]
        self.known: dict[str, str] = {}
        self.starts = self._starts()

    def _child(self, node: int, byte: int) -> tuple[int, bool] | None:
        """The node behind a byte, and whether a key ends there."""
        node ^= byte
        if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
            return None
        unit = self.units[node]
        node ^= self._offset(unit)
        return node, bool(unit >> 8 & 1) and node < len(self.units)

    def _starts(self) -> re.Pattern | None:
        """The first two bytes that keys can have; None where keys may start within a character."""
        if not self.units:
            return re.compile(b"(?!)")
        root, found = self._offset(self.units[0]), []
        for lead in range(1, 256):
            child = self._child(root, lead)
            if child is None:
                continue
            if 0x80 <= lead < 0xC0:
                return None
            first = re.escape(bytes([lead]))
            if child[1]:
                found.append(first)
                continue
            seconds = b"".join(b"\\x%02x" % b for b in range(1, 256) if self._child(child[0], b) is not None)
            found += [first + b"[" + seconds + b"]"] if seconds else []
        return re.compile(b"|".join(found) or b"(?!)")

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest key that starts at this byte."""
        if not self.units:
            return None
        best = None
        node = self._offset(self.units[0])
        for i in range(at, len(data)):
            if not data[i]:
                break
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1 and node < len(self.units):
                begin = self.units[node] & 0x7FFFFFFF
                end = self.pool.find(b"\0", begin)
                best = i + 1 - at, self.pool[begin : end if end >= 0 else len(self.pool)].decode(errors="replace")
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def normalize(self, text: str) -> str:
        if text in self.known:
            return self.known[text]
        data, out, at = text.encode(), [], 0
        while at < len(data):
            if self.starts is not None:  # what no key starts in stays as it is
                near = self.starts.search(data, at)
                stop = near.start() if near else len(data)
                if stop > at:
                    out.append(data[at:stop].decode())
                    at = stop
                    continue
            found = self.longest(data, at)
            if found:
                at += found[0]
                out.append(found[1])
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out.append(data[at : at + size].decode())
                at += size
        made = "".join(out)
        if len(text) < 64:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = made
        return made


@lru_cache(maxsize=8)
def shared_charsmap(blob: bytes) -> CharsMap:
    """The map of these bytes, made once a worker."""
    return CharsMap(blob)


def build_charsmap(pairs: dict[str, str]) -> bytes:
    """A map with these replacements, for tests and for own normalizers."""
    pool, place = bytearray(), {}
    for value in sorted(set(pairs.values())):
        place[value] = len(pool)
        pool += value.encode() + b"\0"
    trie: dict = {}
    for key, value in pairs.items():
        node = trie
        for b in key.encode():
            node = node.setdefault(b, {})
        node[None] = place[value]
    units: dict[int, int] = {0: 0}
    used = {0}
    todo = [(0, trie, 0, False)]
    while todo:
        at, node, label, _ = todo.pop()
        labels = [0 if b is None else b for b in node]
        base = 256
        while (base ^ at) >= 1 << 21 or any((base ^ b) in used for b in labels) or base in used:
            base += 1
        used |= {base ^ b for b in labels} | {base}
        units[at] = label | (1 << 8 if None in node else 0) | (base ^ at) << 10
        if None in node:
            units[base] = node[None] | 1 << 31
        todo += [(base ^ b, child, b, False) for b, child in node.items() if b is not None]
    table = struct.pack(f"<{max(units) + 1}I", *(units.get(i, 0) for i in range(max(units) + 1)))
    return struct.pack("<I", len(table)) + table + bytes(pool)
