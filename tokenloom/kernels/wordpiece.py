"""Greedy longest-match WordPiece."""

from __future__ import annotations

from tokenloom.kernels.pieces import Piece
from tokenloom.spec import WordPieceOptions


class WordPiece:
    def __init__(self, vocab: dict[str, int], options: WordPieceOptions | None = None):
        self.options = options or WordPieceOptions()
        if not vocab or self.options.unk_token not in vocab:
            raise ValueError(f"the vocabulary needs to hold {self.options.unk_token}")
        self.vocab = vocab
        self.longest = max(map(len, vocab))
        self.known: dict[str, list[Piece]] = {}

    def word(self, word: str) -> list[Piece]:
        """Pieces of one word, offsets within it; a word that can't be covered is one unknown."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = self.fresh(word)
        return found

    def fresh(self, word: str) -> list[Piece]:
        """As ``word``, without remembering it."""
        o = self.options
        unknown = [Piece(self.vocab[o.unk_token], o.unk_token, 0, len(word))]
        if len(word) > o.max_input_chars:
            return unknown
        out, at = [], 0
        while at < len(word):
            head = o.prefix if at else ""
            for end in range(min(len(word), at + self.longest - len(head)), at, -1):
                token = head + word[at:end]
                if token in self.vocab:
                    out.append(Piece(self.vocab[token], token, at, end))
                    at = end
                    break
            else:
                return unknown
        return out

    def encode(self, segments: list[tuple[str, int]], limit: int | None = None) -> list[Piece]:
        """Pieces of the segments (text, offset), offsets in the text that they come from."""
        out: list[Piece] = []
        for n, (text, offset) in enumerate(segments):
            out += [Piece(p.id, p.token, offset + p.start, offset + p.end, n) for p in self.word(text)]
            if limit is not None and len(out) >= limit:
                return out[:limit]
        return out
