"""The two kernels of piece models: best path by scores, and merging by piece ids."""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property

import numpy as np

from tokenloom.artifacts import piece_model as pm
from tokenloom.kernels.batches import blank
from tokenloom.kernels.charsmap import CharsMap
from tokenloom.kernels.merging import MERGED_TOGETHER, Pairs, merge, merge_all
from tokenloom.kernels.pieces import SPACES, Piece, text_elements

MARK = "▁"


class SourceText:
    """A normalized text that remembers, for each character, one of the original text: the
    same place where lengths are equal, else the same place or the last; -1 for none."""

    def __init__(self, original: str, mapped: str):
        self.original, self.text = original, mapped
        self.source = [min(i, len(original) - 1) for i in range(len(mapped))]

    def keep(self, chosen: list[tuple[int, str]]) -> None:
        self.text, self.source = "".join(c for _, c in chosen), [self.source[i] for i, _ in chosen]

    def add(self, text: str, behind: bool = False) -> None:
        none = [-1] * len(text)
        self.text, self.source = (self.text + text, self.source + none) if behind else (text + self.text, none + self.source)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Where a piece stands in the original: its visible part, else the visible character
        behind it, else its white space."""
        places = [p for p in self.source[start:end] if p >= 0]
        if not places or not self.original:
            return 0, 0
        visible = [p for p in places if self.original[p] not in SPACES] or [0]
        if visible[-1] > 0 and visible[-1] >= visible[0]:
            return visible[0], visible[-1] + 1
        behind = places[-1] + 1
        if behind < len(self.original) and self.original[behind] not in SPACES:
            return behind, behind + 1
        return places[0], places[-1] + 1


class Path(list):
    """Pieces, with the least lead that any choice on their path has over the next best."""

    margin = np.inf


class _Pieces:
    kind = pm.UNIGRAM

    def __init__(self, model: pm.PieceModel, id_offset: bool = False):
        if model.model_type != self.kind:
            raise ValueError("the model is of another type")
        self.model, self.id_offset = model, id_offset
        self.charsmap = CharsMap(model.charsmap) if model.charsmap else None
        self.ids: dict[str, int] = {}
        for p in model.pieces:
            self.ids.setdefault(p.text, p.id)
        self.text_of = {p.id: p.text for p in model.pieces}
        self.control = {p.id for p in model.pieces if p.type == pm.CONTROL}

    def external(self, i: int) -> int:
        return i + 1 if self.id_offset and i >= 4 else i

    def internal(self, i: int) -> int:
        return i - 1 if self.id_offset and i >= 4 else i

    def _start(self, text: str) -> SourceText:
        return SourceText(text, self.charsmap.normalize(text) if self.charsmap else text)

    def _mapped(self, text: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters of the mapped text, and for each its place in the original."""
        mapped = self.charsmap.normalize(text) if self.charsmap else text
        made = points if mapped == text else np.frombuffer(mapped.encode("utf-32-le"), np.uint32)
        return made, np.minimum(np.arange(len(made)), len(points) - 1)

    @staticmethod
    def _neighbours(texts) -> np.ndarray:
        """The pairs of characters that stand side by side within these texts."""
        return np.array(sorted({ord(a) << 21 | ord(b) for t in texts for a, b in zip(t, t[1:], strict=False)}), np.int64)

    #: Up to so many different characters of pieces, neighbours are looked up in a square of flags.
    SQUARE = 1024

    @cached_property
    def _square(self) -> tuple[np.ndarray, np.ndarray] | None:
        """A number for each character (0: in no pair) and, by two numbers, whether they are neighbours."""
        a, b = self.pairs >> 21, self.pairs & (1 << 21) - 1
        characters = np.unique(np.concatenate([a, b]))
        if len(characters) >= self.SQUARE:
            return None
        number = np.zeros(0x110000, np.int16)
        number[characters] = np.arange(1, len(characters) + 1)
        flags = np.zeros((len(characters) + 1,) * 2, bool)
        flags[number[a], number[b]] = True
        return number, flags

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_square", "_tree", "_merging", "_entries")}

    def _near(self, points: np.ndarray) -> np.ndarray:
        """Which characters but the last may be in one piece with the next."""
        if self._square:
            number, flags = self._square
            at = number[points]
            return flags[at[:-1], at[1:]]
        wide = points.astype(np.int64)
        pair = wide[:-1] << 21 | wide[1:]
        return self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair

    def cuts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the texts at edges[i]:edges[i + 1] are cut: at their edges, and where no piece has
        both neighbours, so that none reaches across."""
        n = len(points)
        cut = np.ones(n + 1, bool)
        if n > 1:
            cut[1:-1] = ~self._near(points)
        if self.elements:  # text elements stay whole
            odd = np.concatenate([[0], np.cumsum(~((points < 0x300) & (points != 13) | (points == ord(MARK))))])[edges]
            for d in np.flatnonzero(np.diff(odd)).tolist():
                a, b = edges[d], edges[d + 1]
                edge = np.zeros(b - a + 1, bool)
                edge[np.cumsum([len(e) for e in text_elements(points[a:b].astype("<u4").tobytes().decode("utf-32-le"))])] = True
                cut[a + 1 : b] &= edge[1:-1]
        cut[edges] = True
        return np.flatnonzero(cut) if n else np.zeros(1, np.int64)

    def parts(self, points: np.ndarray) -> list[str]:
        """A text cut where no piece reaches across."""
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        at = self.cuts(points, np.array([0, len(points)])).tolist()
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class Unigram(_Pieces):
    """Best path over single-precision scores; on ties the path found first, unknowns last."""

    def __init__(self, model: pm.PieceModel, id_offset: bool = False):
        super().__init__(model, id_offset)
        usable = [p for p in model.pieces if p.type in (pm.NORMAL, pm.USER_DEFINED, pm.UNUSED)]
        self.unknown_cost = np.float32(min((p.score for p in usable), default=-90.0) - 10)
        best: dict[str, tuple[np.float32, int]] = {}
        for p in usable:
            if p.text and (p.text not in best or np.float32(p.score) > best[p.text][0]):
                best[p.text] = (np.float32(p.score), p.id)
        lengths = defaultdict(set)
        for text in best:
            lengths[text[0]].add(len(text))
        self.best = best
        self.lengths = {c: sorted(s, reverse=True) for c, s in lengths.items()}
        self.pairs, self.elements = self._neighbours(best), False
        costs = np.array([x for x, _ in best.values()] + [self.unknown_cost], np.float64)
        #: Whether parts can be encoded apart: the scores are numbers, and unknowns known by their text.
        self.apart = bool(np.isfinite(costs).all()) and model.unk_piece not in best
        self.steepest = float(np.abs(costs).max())
        #: Sums below this are exact in single precision, all scores being multiples of one power of two.
        self.exact = next((2.0 ** (24 - k) for k in range(16) if (costs * 2**k % 1 == 0).all()), 0.0) if self.apart else 0.0

    def normalize(self, text: str) -> SourceText:
        out, m = self._start(text), self.model
        if m.remove_extra_whitespaces:
            kept: list[tuple[int, str]] = []
            for i, c in enumerate(out.text):
                if c not in SPACES:
                    kept.append((i, c))
                elif kept and kept[-1][1] != " ":
                    kept.append((i, " "))
            out.keep(kept[:-1] if kept and kept[-1][1] == " " else kept)
        if out.text:
            if m.add_dummy_prefix and not m.whitespace_as_suffix:
                out.add(" ")
            if m.whitespace_as_suffix:
                out.add(" ", behind=True)
            if m.escape_whitespaces:
                out.text = out.text.replace(" ", MARK)
        return out

    def arrays(self, text: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``normalize``: the characters and their places in the original."""
        made, source = self._mapped(text, points)
        m = self.model
        if m.remove_extra_whitespaces:
            empty = blank(made)
            kept = np.flatnonzero(~empty | ~np.concatenate([[True], empty[:-1]]))
            if len(kept) and empty[kept[-1]]:
                kept = kept[:-1]
            made, source = np.where(empty, 32, made)[kept], source[kept]
        if len(made):
            front = [32] * (m.add_dummy_prefix and not m.whitespace_as_suffix)
            back = [32] * bool(m.whitespace_as_suffix)
            made = np.concatenate([front, made, back]).astype(np.uint32)
            source = np.concatenate([np.full(len(front), -1), source, np.full(len(back), -1)])
            if m.escape_whitespaces:
                made[made == 32] = ord(MARK)
        return made, source.astype(np.int64)

    def part(self, text: str) -> Path:
        """The path through a part alone, its scores summed up in double precision."""
        n, unknown, tree, none = len(text), (float(self.unknown_cost), self.external(self.model.unk_id), self.model.unk_piece), self._tree, ({}, None)
        score: list[float] = [0.0] + [-np.inf] * n
        lead = [np.inf] * (n + 1)
        came: list = [None] * (n + 1)
        for i in range(n):
            here, below, j = score[i], tree, i
            while j < n:  # pieces from here on, the short ones first: each ends elsewhere
                below, piece = below.get(text[j], none)
                j += 1
                for ends in ((piece,) if piece else ()) + ((unknown,) if j == i + 1 else ()):
                    total = here + ends[0]
                    more = total - score[j]
                    if more > 0:
                        score[j], came[j], lead[j] = total, (i, ends), more
                    elif -more < lead[j]:
                        lead[j] = -more
                if not below:
                    break
        out, at, margin = Path(), n, np.inf
        while at:
            start, (_, piece, surface) = came[at]
            if lead[at] < margin:
                margin = lead[at]
            out.append((piece, surface, start, at))
            at = start
        out.reverse()
        out.margin = margin
        return out

    @cached_property
    def _tree(self) -> dict:
        """Pieces by their characters: what follows each, and (score, id, text) where a piece ends."""
        tree: dict = {}
        for text, (cost, piece) in self.best.items():
            below = tree
            for c in text[:-1]:
                below = below.setdefault(c, ({}, None))[0]
            below[text[-1]] = (below.get(text[-1], ({},))[0], (float(cost), self.external(piece), text))
        return tree

    def settled(self, entries, entry: np.ndarray, length: np.ndarray, first: np.ndarray, text_of) -> np.ndarray:
        """The entries of parts, those whose path single precision may turn encoded anew from
        the very sum that stands before them. The sum only matters where a choice's lead is
        less than what rounding can move both sides by."""
        if not len(entry):
            return entry
        scores = np.array([self.best[t][0] if t in self.best else self.unknown_cost for t in entries.token_number], np.float32)
        edges = np.concatenate([[0], np.cumsum(np.abs(scores[entries.flat[1]], dtype=np.float64))])
        own = (edges[entries.begin + entries.count] - edges[entries.begin])[entry]
        until = np.concatenate([[0], np.cumsum(own)])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        reach = 1.25 * (until[:-1] - until[first[:-1]][row]) + 2 * length * self.steepest
        spacing = np.spacing(np.minimum(reach, 1e30).astype(np.float32)).astype(np.float64)
        open_ = np.flatnonzero((reach >= self.exact) & (entries.margin[entry] <= 2 * (length + 1) * spacing))
        if not len(open_):
            return entry
        out = entry.copy()
        for d in np.unique(row[open_]).tolist():
            done, total = first[d], np.float32(0)
            for i in open_[row[open_] == d].tolist():
                total = self._run(entries, scores, out[done:i], total)
                text = text_of(i)
                path = [(self.external(p), s, a, b) for p, s, a, b in self.best_path(text, total)]
                key = (text, *(b for _, _, _, b in path), *(p for p, _, _, _ in path))
                if key not in entries.number:
                    entries.add([key], [path])
                out[i] = entries.number[key]
                if len(entries.token_number) > len(scores):
                    scores = np.array([self.best[t][0] if t in self.best else self.unknown_cost for t in entries.token_number], np.float32)
                done = i
        return out

    @staticmethod
    def _run(entries, scores: np.ndarray, entry: np.ndarray, total: np.float32) -> np.float32:
        """The sum behind these entries' pieces, added one by one in single precision."""
        count = entries.count[entry]
        if not count.sum():
            return total
        at = np.arange(count.sum()) + np.repeat(entries.begin[entry] - np.cumsum(count) + count, count)
        return np.add.accumulate(np.concatenate([[total], scores[entries.flat[1][at]]]).astype(np.float32))[-1]

    def best_path(self, text: str, before: np.float32 = np.float32(0)) -> list[tuple[int, str, int, int]]:  # noqa: B008
        """(id, surface, start, end) along the best path, from a sum of scores on."""
        n = len(text)
        score: list[np.float32 | None] = [before] + [None] * n
        came: list[tuple[int, int, str]] = [(0, 0, "")] * (n + 1)
        for i in range(n):
            here = score[i]
            for size in self.lengths.get(text[i], ()):
                found = self.best.get(text[i : i + size]) if i + size <= n else None
                if found is not None:
                    total = here + found[0]
                    if score[i + size] is None or total > score[i + size]:
                        score[i + size], came[i + size] = total, (i, found[1], text[i : i + size])
            total = here + self.unknown_cost
            if score[i + 1] is None or total > score[i + 1]:
                score[i + 1], came[i + 1] = total, (i, self.model.unk_id, self.model.unk_piece)
        out, at = [], n
        while at:
            start, piece, surface = came[at]
            out.append((piece, surface, start, at))
            at = start
        return out[::-1]

    def encode(self, text: str, limit: int | None = None) -> list[Piece]:
        source = self.normalize(text)
        found = self.best_path(source.text)[:limit]
        return [Piece(self.external(i), s, *source.span(a, b)) for i, s, a, b in found]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text_of.get(self.internal(i), "") for i in ids).replace(MARK, " ").strip(" ")


def derive_merges(vocab: dict[str, int]) -> dict[tuple[str, str], tuple[int, str]]:
    """Every way to split a piece into two pieces, ranked by the piece's id and the place."""
    rules: dict[tuple[str, str], tuple[int, str]] = {}
    for piece, _ in sorted(vocab.items(), key=lambda x: x[1]):
        for k in range(1, len(piece)):
            if piece[:k] in vocab and piece[k:] in vocab:
                rules.setdefault((piece[:k], piece[k:]), (len(rules), piece))
    return rules


class PieceMerges(_Pieces):
    """The whole text is one segment, merged by rules that the pieces imply."""

    kind = pm.BPE

    def __init__(self, model: pm.PieceModel, id_offset: bool = False, add_dummy_prefix: bool = True):
        super().__init__(model, id_offset)
        self.rules = derive_merges(self.ids)
        self.prefix = model.add_dummy_prefix and add_dummy_prefix
        self.unknown = self.text_of.get(model.unk_id, model.unk_piece)
        self.pairs, self.elements = self._neighbours(self.ids), True
        #: Whether parts can be encoded apart: an unknown, which may stand for anything, merges with nothing.
        self.apart = not any(self.unknown in pair for pair in self.rules)

    def normalize(self, text: str) -> SourceText:
        out = self._start(text)
        out.keep([(i, c) for i, c in enumerate(out.text) if c != " " or not i or out.text[i - 1] != " "])
        if self.prefix:
            out.add(" ")
        out.text = out.text.replace(" ", MARK)
        return out

    def arrays(self, text: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``normalize``: the characters and their places in the original."""
        made, source = self._mapped(text, points)
        space = made == 32
        kept = np.flatnonzero(~space | ~np.concatenate([[False], space[:-1]]))
        front = [32] * bool(self.prefix)
        made = np.concatenate([front, made[kept]]).astype(np.uint32)
        made[made == 32] = ord(MARK)
        return made, np.concatenate([np.full(len(front), -1), source[kept]]).astype(np.int64)

    def part(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, surface, start, end) of a part; places are those of the part's characters."""
        elements = text_elements(text)
        begin = np.concatenate([[0], np.cumsum([len(e) for e in elements])]).astype(int).tolist()
        merged = merge([e if e in self.ids else self.unknown for e in elements], lambda a, b: self.rules.get((a, b)))
        return [(self.external(self.ids[s]), s, begin[i], begin[j]) for s, i, j in merged]

    @cached_property
    def _merging(self) -> tuple[Pairs, np.ndarray, np.ndarray, list[tuple[int, str]]] | None:
        """The rules over numbered pieces, the characters that are pieces, what these and all others
        are at first, and id and text of each number."""
        number = {t: i for i, t in enumerate(self.ids)}
        if self.unknown not in number:
            return None
        single = sorted(t for t in number if len(t) == 1)
        first = np.array([*(number[c] for c in single), number[self.unknown]], np.int64)
        pairs = Pairs({(number[a], number[b]): (rank, number[made]) for (a, b), (rank, made) in self.rules.items()})
        return pairs, np.array([ord(c) for c in single], np.int64), first, [(self.external(self.ids[t]), t) for t in number]

    def fresh_parts(self, texts: list[str]) -> list[list[tuple[int, str, int, int]]]:
        """``part`` of many, merged together; long ones and those with elements of several characters apart."""
        together = [k for k, t in enumerate(texts) if len(t) <= MERGED_TOGETHER and (t.isascii() and "\r" not in t or len(text_elements(t)) == len(t))] if self._merging else []
        out: list = [None] * len(texts)
        if together:
            pairs, single, first, shown = self._merging
            points = np.frombuffer("".join(texts[k] for k in together).encode("utf-32-le"), np.uint32).astype(np.int64)
            length = np.array([len(texts[k]) for k in together])
            row, begin = np.repeat(np.arange(len(together)), length), np.cumsum(length) - length
            spot = np.searchsorted(single, points)
            spot = np.where(np.append(single, -1)[spot] == points, spot, len(single))
            symbol, place = merge_all(first[spot], row, pairs)
            at, end = place - begin[row[place]], np.append(place[1:], len(row)) - begin[row[place]]
            pieces = [(*shown[s], a, b) for s, a, b in zip(symbol.tolist(), at.tolist(), end.tolist(), strict=True)]
            edges = np.searchsorted(row[place], np.arange(len(together) + 1)).tolist()
            for n, k in enumerate(together):
                out[k] = pieces[edges[n] : edges[n + 1]]
        return [self.part(texts[k]) if x is None else x for k, x in enumerate(out)]

    def encode(self, text: str, limit: int | None = None) -> list[Piece]:
        source = self.normalize(text)
        elements = text_elements(source.text)
        begin = np.concatenate([[0], np.cumsum([len(e) for e in elements])]).astype(int).tolist()
        merged = merge([e if e in self.ids else self.unknown for e in elements], lambda a, b: self.rules.get((a, b)))
        return [Piece(self.external(self.ids[s]), s, *source.span(begin[i], begin[j])) for s, i, j in merged[:limit]]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text_of.get(self.internal(i), "") for i in ids).replace(MARK, " ").strip(" ")
