"""The printable byte alphabet of byte-level tokenizers."""

from __future__ import annotations

#: Printable bytes stand for themselves; the others, in order, for U+0100 and on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_TO_CHAR: dict[int, str] = {b: chr(b) for b in sorted(_PLAIN)}
BYTE_TO_CHAR |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
CHAR_TO_BYTE: dict[str, int] = {c: b for b, c in BYTE_TO_CHAR.items()}


def to_alphabet(data: bytes) -> str:
    return "".join(map(BYTE_TO_CHAR.__getitem__, data))
