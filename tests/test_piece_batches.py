"""Piece models over batches of texts: as their text by text encoding, parts and sums included."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.artifacts import piece_model as pm
from tokenloom.kernels import piece_batches
from tokenloom.kernels.charsmap import CharsMap, build_charsmap
from tokenloom.kernels.piece_models import PieceMerges, Unigram

TEXTS = ["", " ", None, "a", "  ab  abc\tb a ", " ab\n\nba ", "漢字ab漢 c", "éa؀ ab", "a\r\nb", "▁a ▁▁b", "🇩🇪🇫🇷ab👩‍🔬", "x" * 50, "ab" * 300 + " " + "cab " * 400, "a ́b"]


def unigram(scores, **options):
    pieces = [pm.Piece(0, "<unk>", 0.0, pm.UNKNOWN)] + [pm.Piece(i + 1, t, x, pm.NORMAL) for i, (t, x) in enumerate(scores.items())]
    return Unigram(pm.PieceModel(tuple(pieces), **options))


def merges(texts, **options):
    return PieceMerges(pm.PieceModel(tuple(pm.Piece(i, t, 0.0, pm.NORMAL) for i, t in enumerate(["<unk>", *texts])), pm.BPE, **options))


def check(model, texts, limit=None):
    assert model.apart
    rows = piece_batches.encode(model, pa.array(texts, pa.string()), limit).to_pylist()
    for t, row in zip(texts, rows, strict=True):
        if t is None:
            assert row["ids"] is None
            continue
        want = model.encode(t, limit)
        assert row["ids"] == [p.id for p in want], t
        assert row["tokens"] == [p.token for p in want]
        assert [(o["start"], o["end"]) for o in row["offsets"]] == [(p.start, p.end) for p in want], t


WORDS = ["▁", "a", "b", "c", "ab", "▁a", "▁ab", "ba", "cab", "a▁", "▁▁", "é", "漢"]


@pytest.mark.parametrize("options", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": False}, {"escape_whitespaces": False}, {"whitespace_as_suffix": True}, {"charsmap": build_charsmap({"\n": " ", "漢": "cab", "é": ""})}])
@pytest.mark.parametrize("limit", [None, 3])
def test_batches_equal_texts(options, limit):
    check(unigram({w: -1.5 - i / 8 for i, w in enumerate(WORDS)}, **options), TEXTS, limit)
    check(merges(WORDS, **options), TEXTS, limit)


def test_sums_in_single_precision_decide():
    """Long texts, whose sums leave hardly any digits to single scores; many paths are near ties."""
    draw = random.Random(5)
    differ = 0
    for scale in (1.0, 3000.0):
        words = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 4))): -scale * (1 + draw.choice([0.1, 0.2, 0.3]) + draw.random() * 1e-4) for _ in range(40)}
        model = unigram(words)
        texts = [" ".join("".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(n)) for n in (5, 300, 4000)]
        check(model, texts)
        for t in texts:  # the same parts alone have other paths
            made = model.arrays(t, np.frombuffer(t.encode("utf-32-le"), np.uint32))[0]
            differ += [p.id for p in model.encode(t)] != [i for part in model.parts(made) for i, *_ in model.part(part)]
    assert differ


def test_each_distinct_part_is_encoded_once():
    model, seen = unigram({w: -1.0 - i for i, w in enumerate(["▁", "a", "b", "ab"])}), []
    own = model.part
    model.part = lambda text: seen.append(text) or own(text)
    piece_batches.encode(model, pa.array(["ab a b " * 500] * 20), None)
    assert len(seen) == len(set(seen)) < 10


def test_character_maps_seek_only_where_keys_start():
    table = CharsMap(build_charsmap({"é": "e", "ß": "ss", "ab": "x", "漢字": "k", "a": "y"}))
    asked, own = [], table.longest
    table.longest = lambda data, at: asked.append(at) or own(data, at)
    text = "Ünrelated wörds, né 漢 漢字 ß ab a" + "." * 5000

    def plain(t):
        keys = sorted(["é", "ß", "ab", "漢字", "a"], key=len, reverse=True)
        to, out, i = {"é": "e", "ß": "ss", "ab": "x", "漢字": "k", "a": "y"}, "", 0
        while i < len(t):
            k = next((k for k in keys if t.startswith(k, i)), None)
            out, i = out + (to[k] if k else t[i]), i + (len(k) if k else 1)
        return out

    assert table.normalize(text) == plain(text) and len(asked) < 20
