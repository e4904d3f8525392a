"""The tokens that a model makes of a single word."""

from __future__ import annotations


class WordTokens:
    """``mode``: word (a word's pieces), path (best path, no normalization) or encode."""

    def __init__(self, model, mode: str):
        self.model, self.mode = model, mode

    def __call__(self, word: str) -> list[str]:
        if self.mode == "word":
            return [p.token for p in self.model.word(word)]
        if self.mode == "path":
            return [s for _, s, _, _ in self.model.best_path(word)]
        return [p.token for p in self.model.encode(word)]
