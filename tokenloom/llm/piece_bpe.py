"""Operator 6, exact encoding and decoding with a SentencePiece model of the BPE type.

Encoding is by backtracking: an Aho-Corasick automaton finds all pieces at each place, the
longest is tried first, and it may follow the piece before it only if merging the two
pieces' characters anew gives back just these two. Places from which no way leads on are
kept in a bit field. A text is first cut between characters that stand side by side in no
piece at all: no merge crosses such a place, so the parts are independent, and each
distinct part is encoded once in a worker.

Defined results: null texts count as empty, which has no ids and decodes to the empty text;
rows are independent of each other, so equal rows get equal results; other columns are left
alone. Models with user-defined or unused pieces, a character map, or white space that is
cut or suffixed are refused."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.artifacts import piece_model as pm
from tokenloom.llm.common import Memo, map_batches, resident, slices

SPACE = "▁"
#: Code points below it have classes of their own where texts are cut; then the space mark, then all others.
_OWN = 510
_PAIRS_KEPT = 500_000


class PieceBpe:
    def __init__(self, path: str):
        model = pm.read_piece_model(path)
        kinds = {p.type for p in model.pieces}
        if model.model_type != pm.BPE or kinds & {pm.USER_DEFINED, pm.UNUSED} or model.charsmap or model.remove_extra_whitespaces or model.whitespace_as_suffix or not model.escape_whitespaces:
            raise ValueError("a BPE model with normal pieces and identity normalization is needed")
        self.prefix = SPACE if model.add_dummy_prefix else ""
        self.unk, self.by_bytes = model.unk_id, model.byte_fallback
        normal = [p for p in model.pieces if p.type == pm.NORMAL]
        self.score = {p.text: p.score for p in normal}
        self.text = {p.id: p.text for p in normal}
        self.size = {p.id: len(p.text) for p in normal}
        if any(c not in self.score for p in normal for c in p.text):
            raise ValueError("every character of a piece has to be a piece")
        self.byte_ids = {int(p.text[3:-1], 16): p.id for p in model.pieces if p.type == pm.BYTE}
        self.bytes_of = {p.id: p.text.replace(SPACE, " ").encode() for p in normal} | {i: bytes([b]) for b, i in self.byte_ids.items()} | {self.unk: " ⁇ ".encode()}
        self.found = ahocorasick.Automaton()
        for p in normal:
            self.found.add_word(p.text, (len(p.text), p.id))
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.joined = np.zeros((_OWN + 2, _OWN + 2), bool)
        self.joined[_OWN + 1, :_OWN] = self.joined[:, _OWN + 1] = True
        for p in normal:
            c = self._classes(np.frombuffer(p.text.encode("utf-32-le"), np.uint32))
            self.joined[c[:-1], c[1:]] = True
        self.memo = Memo(self._compute, (np.int32, np.uint8))

    @staticmethod
    def _classes(points: np.ndarray) -> np.ndarray:
        return np.where(points == ord(SPACE), _OWN, np.where(points < _OWN, points, _OWN + 1))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: always the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side as they are; for a = -1,
        whether it can make b at all."""
        if len(self.pairs) > _PAIRS_KEPT:
            self.pairs.clear()
        left, right = self.text.get(a, ""), self.text[b]
        known = self.pairs[a << 20 | b] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def pieces(self, text: str) -> list[int] | None:
        """The ids of a text; None if some of its characters are in no piece."""
        at_place: list[list[int]] = [[] for _ in text]
        for end, (size, piece) in self.found.iter(text):
            at_place[end + 1 - size].append(piece)  # ends ascend, so sizes at a place do
        if not all(at_place):
            return None
        size_of, pairs = self.size, self.pairs
        out: list[int] = []
        rank: list[int] = []  # which of the pieces at its place each one was
        failed = bytearray(len(text) + 1)
        at, last, choice = 0, -1, len(at_place[0]) - 1
        while True:
            here = at_place[at]
            while choice >= 0:
                piece = here[choice]
                end = at + size_of[piece]
                if not failed[end]:
                    fits = pairs.get(last << 20 | piece)
                    if fits or fits is None and self.follows(last, piece):
                        break
                choice -= 1
            if choice >= 0:
                out.append(piece)
                rank.append(choice)
                at, last = end, piece
                if at == len(text):
                    return out
                choice = len(at_place[at]) - 1
            else:
                failed[at] = 1
                at -= size_of[out.pop()]
                choice, last = rank.pop() - 1, out[-1] if out else -1

    def unit(self, text: str) -> list[int]:
        """The ids of any text that holds no place to cut at, unknown characters by bytes."""
        whole = self.pieces(text)
        if whole is not None:
            return whole
        ids: list[int] = []
        for known, run in groupby(text, self.score.__contains__):
            if known:
                ids += self.pieces("".join(run))
            else:
                ids += [self.byte_ids[b] for b in "".join(run).encode()] if self.by_bytes else [self.unk for _ in run]
        return ids

    def _compute(self, runs: list[bytes]) -> tuple[list, list]:
        ids = [self.unit(run.decode("utf-32-le")) for run in runs]
        return ids, [b"".join(map(self.bytes_of.__getitem__, i)) for i in ids]

    def code_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the bytes that they decode to, of all texts back to back, with offsets."""
        texts = [self.prefix + t if t else "" for t in col.to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        points = np.frombuffer("".join(texts).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(points) + 1, bool)
        if len(points):
            c = self._classes(points)
            edge[1:-1] = ~self.joined[c[:-1], c[1:]]
        edge[off] = True
        starts = np.flatnonzero(edge[:-1])
        entries = self.memo.entries(points, starts, np.diff(starts, append=len(points)))
        (ids, id_ends), (back, back_ends) = (pool.gather(entries) for pool in self.memo.pools)
        first = np.searchsorted(starts, off)
        ends = back_ends[first]
        if self.prefix and len(texts):  # decoding drops the space that encoding put first
            keep = np.ones(len(back), bool)
            full = np.diff(ends) > 0
            begin = ends[:-1][full]
            keep[begin[back[begin] == 32]] = False
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            back = back[keep]
        return ids, id_ends[first], back, ends


def piece_bpe(path: str) -> PieceBpe:
    return resident(("piece_bpe", path), lambda: PieceBpe(path))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_bpe(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, off, back, ends = coder.code_column(part.column(1))
                text = pa.StringArray.from_buffers(len(part), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(back)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)), text], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
