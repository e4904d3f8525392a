"""Exact ids of a tokenizers file of the word-BPE kind (lower case, white space dropped,
word ends), at the speed of a table: a text is cut where that pipeline is sure to cut, and
the library's own model encodes each distinct part once in a worker."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tokenloom.kernels.alphabet import BYTE_TO_CHAR
from tokenloom.llm.common import Memo, latin_capitals, lookup, resident, utf8

#: Classes of bytes: white space, letters, other signs, digits, and those whose whole
#: chunk between ASCII white space goes through the library's full pipeline (apostrophes
#: of contractions, "<" of special tokens, controls, and all but Latin-1 letters outside ASCII).
SPACE, LETTER, SIGN, DIGIT, WHOLE = range(5)
_LETTERS = {*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3}
_CLASSES = (
    {b: SIGN for b in range(33, 127)}
    | {b: LETTER for b in _LETTERS}
    | {b: DIGIT for b in range(48, 58)}
    | {b: SPACE for b in (9, 10, 11, 12, 13, 32)}
    | {b: WHOLE for b in b"'<"}
)
_CLASS = lookup(_CLASSES, WHOLE)
_LOWER = lookup({b: b + 32 for b in range(65, 91)})
_SURE = bytes(b for b, c in _CLASSES.items() if c != WHOLE)
_ALPHABET = {b: c for b, c in BYTE_TO_CHAR.items()}


class WordBpe:
    """``encode_column`` gives the ids of each text, as encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.memo = Memo(self._compute, (np.uint32,))

    def _compute(self, runs: list[bytes]) -> tuple[list]:
        out, tokenize, full = [], self.model.tokenize, self.full.encode
        for run in runs:
            if run.isascii() and not run.translate(None, _SURE):
                out.append([t.id for t in tokenize(run.decode("ascii"))])
            elif run.translate(None, _SURE) or b"\xc3\x97" in run or b"\xc3\xb7" in run:
                out.append(full(run.decode(), add_special_tokens=False).ids)
            else:
                out.append([t.id for t in tokenize(run.decode("latin-1").translate(_ALPHABET))])
        return (out,)

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and len + 1 offsets; null texts count as empty."""
        raw, off = utf8(col)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        text = raw.tobytes()
        cls, data = (np.frombuffer(bytearray(text.translate(t)), np.uint8) for t in (_CLASS, _LOWER))
        if 0xC3 in text:
            data[latin_capitals(raw)] += 32
            at = np.flatnonzero(raw[:-1] == 0xC3) + 1
            cls[at[(raw[at] == 0x97) | (raw[at] == 0xB7)]] = WHOLE  # signs, not letters
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = cls[1:] != cls[:-1]
        edge[:-1] |= cls == DIGIT
        edge[off] = True
        odd = np.flatnonzero(cls == WHOLE)
        if len(odd):
            self._join_chunks(raw, off, cls, data, edge, odd)
        at = np.flatnonzero(edge[:-1])
        kept = cls[at] != SPACE
        starts, lengths = at[kept], np.diff(at, append=len(raw))[kept]
        entries = self.memo.entries(data, starts, lengths)
        ids, ends = self.memo.pools[0].gather(entries)
        return ids, ends[np.searchsorted(starts, off)]

    @staticmethod
    def _join_chunks(raw, off, cls, data, edge, odd) -> None:
        """Makes each chunk between white space that holds an odd byte one run, as it was."""
        solid = cls != SPACE
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = solid[1:] != solid[:-1]
        cut[off] = True
        at = np.flatnonzero(cut)
        for k in np.unique(np.searchsorted(at, odd, side="right") - 1).tolist():
            i, j = at[k], at[k + 1]
            edge[i + 1 : j] = False
            cls[i:j] = WHOLE
            data[i:j] = raw[i:j]


def word_bpe(path: str) -> WordBpe:
    """One table a worker and file."""
    return resident(("word_bpe", path), lambda: WordBpe(path))
