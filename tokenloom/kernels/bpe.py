"""Byte-pair encoding by merge rules, plain or byte-level, with added tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from tokenloom.kernels.alphabet import BYTE_TO_CHAR, CHAR_TO_BYTE, to_alphabet
from tokenloom.kernels.merging import Pairs, byte_symbols, merge
from tokenloom.kernels.pieces import SPACE, SPACES, Piece, placed, text_elements
from tokenloom.spec import AddedToken, BpeOptions

_GPT2 = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_WORDS = regex.compile(rf"[^{SPACE}]+")


class Bpe:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], options: BpeOptions | None = None, ranks: list[int] | None = None):
        """``ranks``: the merges' ranks, where they aren't their places."""
        self.vocab, self.options = vocab, options or BpeOptions()
        self.token_of = {i: t for t, i in vocab.items()}
        self.rules: dict[tuple[str, str], tuple[int, str]] = {}
        prefix = self.options.prefix
        for k, (a, b) in enumerate(merges):
            made = a + (b[len(prefix) :] if prefix and b.startswith(prefix) else b)
            if made in vocab:  # rules whose result has no id are dropped
                self.rules.setdefault((a, b), (ranks[k] if ranks else k, made))
        self.known: dict[str, list[tuple[int, str, int, int]]] = {}

    def segments(self, text: str) -> list[tuple[str, int, int]]:
        """(segment, offset, length of a prefix that isn't in the text)."""
        o = self.options
        if not text:
            return []
        if o.byte_level:
            added = int(o.add_prefix_space and text[0] not in SPACES)
            full = " " * added + text
            spans = [m.span() for m in _GPT2.finditer(full)] if o.use_regex else [(0, len(full))]
            return [(full[a:b], a - added, added if not a else 0) for a, b in spans]
        if o.split_whitespace:
            return [(m[0], m.start(), 0) for m in _WORDS.finditer(text)]
        return [(text, 0, 0)]

    def symbols(self, segment: str) -> list[tuple[str, int, int]]:
        """First symbols of a segment with the text elements' offsets."""
        out, at, o = [], 0, self.options
        elements = text_elements(segment)
        for i, e in enumerate(elements):
            if o.byte_level:
                out += [(c, at, at + len(e)) for c in to_alphabet(e.encode())]
            else:
                s = (o.prefix if i and o.prefix else "") + e + (o.suffix if i == len(elements) - 1 else "")
                out.append((s, at, at + len(e)))
            at += len(e)
        return [(self._known_symbol(s), a, b) for s, a, b in out]

    def _known_symbol(self, s: str) -> str:
        if s in self.vocab:
            return s
        if self.options.unk_token is not None and self.options.unk_token in self.vocab:
            return self.options.unk_token
        raise KeyError(f"no id for {s!r} and no unknown token")

    def segment(self, segment: str) -> list[tuple[int, str, int, int]]:
        """(id, token, start, end) of a segment, offsets within it."""
        found = self.known.get(segment)
        if found is None:
            first = self.symbols(segment)
            merged = merge([s for s, _, _ in first], lambda a, b: self.rules.get((a, b)))
            found = [(self.vocab[s], s, first[i][1], first[j - 1][2]) for s, i, j in merged]
            if len(segment) < 64:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[segment] = found
        return found

    def cut(self, text: str, base: int = 0, first_word: int = 0) -> list[tuple[str, int, int, int | None]]:
        """(segment, offset, base, word): pieces move by the offset, 0 at least, then by the base."""
        return [(segment, offset, base, first_word + n) for n, (segment, offset, _) in enumerate(self.segments(text))]

    part = segment

    def parts(self, segments: list[str]) -> list[list[tuple[int, str, int, int]]]:
        """``part`` of many segments; those of single-character elements are merged together."""
        if not self.options.byte_level or not all(c in self.vocab for c in BYTE_TO_CHAR.values()):
            return [self.part(s) for s in segments]
        if "_pairs" not in self.__dict__:
            number = {t: i for i, t in enumerate(self.vocab)}
            self._pairs = Pairs({(number[a], number[b]): (rank, number[made]) for (a, b), (rank, made) in self.rules.items() if a in number and b in number})
            self._first = np.array([number[BYTE_TO_CHAR[b]] for b in range(256)])
            self._shown = list(self.vocab.items())
        return byte_symbols(segments, self._pairs, self._first, lambda s: (self._shown[s][1], self._shown[s][0]), self.part)

    def encode(self, text: str, limit: int | None = None) -> list[Piece]:
        return placed(self, text, limit)

    def decode(self, ids: list[int]) -> str:
        unk = self.options.unk_token or ""
        tokens = [self.token_of.get(i, unk) for i in ids]
        if self.options.byte_level:
            return from_alphabet("".join(tokens))
        suffix = self.options.suffix
        if suffix:
            return "".join(t.replace(suffix, " " if k < len(tokens) - 1 else "") for k, t in enumerate(tokens)).rstrip()
        return "".join(tokens)


def alphabet_bytes(text: str) -> bytes:
    """The bytes that characters of the printable alphabet stand for; others stand for themselves."""
    return b"".join(_BYTES_OF[c] if c in _BYTES_OF else c.encode() for c in text)


_BYTES_OF = {c: bytes([b]) for c, b in CHAR_TO_BYTE.items()}
#: The byte of each character of the alphabet; -1 for others, for all behind the last too.
_BYTE_AT = np.array([CHAR_TO_BYTE.get(chr(i), -1) for i in range(max(map(ord, CHAR_TO_BYTE)) + 2)])


def from_alphabet(text: str) -> str:
    """Bytes of the printable alphabet as UTF-8 text; other characters stand for themselves."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    data = _BYTE_AT[np.minimum(points, len(_BYTE_AT) - 1)]
    return (data.astype(np.uint8).tobytes() if (data >= 0).all() else alphabet_bytes(text)).decode(errors="replace")


def _word_sign(c: str) -> bool:
    return c.isalpha() or c == "_" or regex.fullmatch(r"\p{Nd}", c) is not None


class AddedTokens:
    """Finds added tokens in a text: the earliest, of those the longest."""

    def __init__(self, tokens: tuple[AddedToken, ...], normalize: Callable[[str], str] | None = None):
        self.tokens = sorted((t for t in tokens if t.content), key=lambda t: -len(t.content))
        self.normalize = normalize

    def find(self, text: str) -> list[tuple[AddedToken, int, int]]:
        """Tokens with the span that each takes, white space that it swallows included."""
        folded = self.normalize(text) if self.normalize else text
        if len(folded) != len(text):
            folded = None
        out, at = [], 0
        while at < len(text):
            best = None
            for t in self.tokens:
                within = folded if t.normalized and self.normalize else text
                i = within.find(t.content, at) if within is not None else -1
                while i >= 0 and t.single_word and (i and _word_sign(text[i - 1]) or i + len(t.content) < len(text) and _word_sign(text[i + len(t.content)])):
                    i = within.find(t.content, i + 1)
                if i >= 0 and (best is None or i < best[1]):
                    best = (t, i, i + len(t.content))
            if best is None:
                break
            t, a, b = best
            while t.lstrip and a > at and text[a - 1] in SPACES:
                a -= 1
            while t.rstrip and b < len(text) and text[b] in SPACES:
                b += 1
            out.append((t, a, b))
            at = b
        return out


class BpeWithAdded:
    """A BPE model and its added tokens. Word numbers run on across the parts between added
    tokens, which have none."""

    def __init__(self, model: Bpe, added: AddedTokens):
        self.model, self.added = model, added

    def cut(self, text: str) -> list[tuple[str | AddedToken, int, int, int | None]]:
        out: list[tuple] = []
        at = words = 0
        for token, a, b in [*self.added.find(text), (None, len(text), len(text))]:
            if a > at:
                own = self.model.cut(text[at:a], at, words)
                words += len(own)
                out += own
            if token is not None:
                out.append(((token, b - a), 0, a, None))
            at = b
        return out

    def parts(self, keys: list) -> list:
        made = iter(self.model.parts([k for k in keys if isinstance(k, str)]))
        return [next(made) if isinstance(k, str) else self.part(k) for k in keys]

    def part(self, key: str | tuple[AddedToken, int]) -> list[tuple[int, str, int, int]]:
        return self.model.part(key) if isinstance(key, str) else [(key[0].id, key[0].content, 0, key[1])]

    def encode(self, text: str, limit: int | None = None) -> list[Piece]:
        return placed(self, text, limit)


def encode_with_added(model: Bpe, added: AddedTokens, text: str, limit: int | None = None) -> list[Piece]:
    return BpeWithAdded(model, added).encode(text, limit)
