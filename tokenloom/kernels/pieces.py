"""What kernels share."""

from __future__ import annotations

from typing import NamedTuple

import regex

#: White space as the engine understands it (fixed values).
SPACES = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"\f\n\r\t\x0B\x85\p{Z}"
_ELEMENT = regex.compile(r"\X")


class Piece(NamedTuple):
    id: int
    token: str
    start: int
    end: int
    word: int | None = None


def placed(model, text: str, limit: int | None = None) -> list[Piece]:
    """The pieces of a text by a model that cuts texts (``cut``) and encodes parts (``part``)."""
    out: list[Piece] = []
    for key, offset, base, word in model.cut(text):
        out += [Piece(i, t, max(0, a + offset) + base, max(0, b + offset) + base, word) for i, t, a, b in model.part(key)]
        if limit is not None and len(out) >= limit:
            return out[:limit]
    return out


def text_elements(text: str) -> list[str]:
    """The extended grapheme clusters of a text."""
    return list(text) if text.isascii() and "\r\n" not in text else _ELEMENT.findall(text)


def lower_each(text: str) -> str:
    """Lower case that keeps every character one character."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)
