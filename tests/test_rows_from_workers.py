"""Rows, ids and texts that workers give without arrays in between: as those made by expressions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from test_piece_batches import WORDS, check, merges, unigram

from tokenloom.functions import decoders
from tokenloom.functions import pretokenizers as P
from tokenloom.kernels import batches, merging, piece_batches
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.operators import decode as D
from tokenloom.operators import encode as E
from tokenloom.operators.segments import segments_relation
from tokenloom.operators.words import _finder, count_words
from tokenloom.spec import EncodeOptions, TokenizerSpec

TEXTS = ["ab the ##x cab", "", None, "  ab\n\nba 漢 é", "the'll , ab ! the s", "ab" * 200, "[CLS] ab [UNK]"]
SPECIALS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").coalesce(1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sp_spec():
    return TokenizerSpec("SentencePieceBpe", merges(WORDS))


def wordpiece():
    tokens = [*SPECIALS, *"abcdehlstx'!,#[]", *(f"##{c}" for c in "abcdehlstx"), "the", "cab", "##ab"]
    return TokenizerSpec("WordPiece", WordPiece({t: i for i, t in enumerate(tokens)}), special_ids=SPECIALS)


def test_decoding_runs_in_the_worker_that_encodes(docs):
    """one evaluation, so half the workers; ids don't cross to the JVM and back."""
    for spec in (sp_spec(), wordpiece()):
        out = D.decode(E.encode_to_ids(docs, spec), spec, skip_special_tokens=True).select("k", "decoded")
        assert plan(out).count("ArrowEvalPython") == 1
        ids = {r.k: r.encoding and r.encoding.ids for r in E.encode(docs, spec).collect()}
        apart = docs.sparkSession.createDataFrame(list(ids.items()), "k int, ids array<int>")
        assert {r.k: r.decoded for r in out.collect()} == {r.k: r.decoded for r in D.decode(apart, spec, skip_special_tokens=True).collect()}
        assert {r.k: r.ids for r in E.encode_to_ids(docs, spec).collect()} == ids


def test_pieces_are_glued_as_the_decoder_does(docs):
    """words are put together by arrays, as the expressions over tokens put them."""
    spec, draw = wordpiece(), random.Random(3)
    names = {i: t for t, i in spec.model.vocab.items()}
    rows = [[draw.choice([*names, 999, -1]) for _ in range(draw.randint(0, 9))] for _ in range(60)] + [None, [], [999], [spec.model.vocab["##ab"]]]
    df = docs.sparkSession.createDataFrame(list(enumerate(rows)), "k int, ids array<int>")
    skipped = {"[CLS]", "[SEP]", "[PAD]", "[MASK]"}
    tokens = [None if r is None else [names[i] for i in r if i in names and names[i] not in skipped] for r in rows]
    want = docs.sparkSession.createDataFrame(list(enumerate(tokens)), "k int, tokens array<string>").select("k", decoders.wordpiece()("tokens").alias("t"))
    assert "transform(" not in plan(D.decode(df, spec, skip_special_tokens=True))
    assert {r.k: r.decoded for r in D.decode(df, spec, skip_special_tokens=True).collect()} == {r.k: r.t for r in want.collect()}


@pytest.mark.parametrize("front,back", [([], []), ([7], []), ([7, 8], [9]), ([], [9, 10])])
def test_specials_surround_ids(front, back):
    rows = [[1, 2], None, [], [3]]
    made = batches.surrounded(pa.array(rows, pa.list_(pa.int32())), front, back)
    assert made.to_pylist() == [None if r is None else [*front, *r, *back] for r in rows]


def test_rows_of_tokens_equal_those_of_arrays(docs):
    """no arrays of a text's tokens are zipped and exploded."""
    for spec, bare in ((sp_spec(), True), (TokenizerSpec("SentencePieceUnigram", unigram({w: -1.5 - i / 8 for i, w in enumerate(WORDS)})), True), (wordpiece(), False)):
        rows = E.encode_to_rows(docs, spec, ["k"])
        assert ("Generate" not in plan(rows)) == bare
        want = E.tokens_relation(E.encode_fields(docs, spec, ["ids", "tokens", "offsets"]), None, ["k"])
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
        assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in want.schema]


def test_rows_are_handed_on_in_bounded_batches():
    lists = pa.array([[1] * (batches.ROWS + 5), None, [], [2, 3]], pa.list_(pa.int32()))
    made = list(batches.exploded([pa.array(["a", "b", "c", "d"])], lists, [lists.flatten()], ["k", "pos", "x"]))
    assert max(b.num_rows for b in made) <= batches.ROWS
    rows = pa.Table.from_batches(made).to_pylist()
    assert rows == [{"k": "a", "pos": i, "x": 1} for i in range(batches.ROWS + 5)] + [{"k": "d", "pos": 0, "x": 2}, {"k": "d", "pos": 1, "x": 3}]


def test_places_of_segments_are_counted_not_searched(monkeypatch):
    """a batch with segments that hold white space was searched segment by segment, as was
    every text beside one whose segments don't add up."""
    texts = ["ab cd 漢字 ef", None, "", "a b", "one two", " x", "aaa"]
    cut = [regex.findall("(?s).{1,5}", t or "") for t in texts]
    cut[3], cut[4], cut[5] = ["a", "b"], ["o", "two"], ["x", ""]
    column, searched = pa.array(texts), []

    own = batches.np.flatnonzero
    lists = pa.array([None if t is None else c for t, c in zip(texts, cut, strict=True)], pa.list_(pa.string()))
    first, flat, lost = batches.flattened(column, lists)
    got = batches.places(column, flat, first, lost)
    want = []
    for t, c in zip(texts, cut, strict=True):
        at = 0
        for s in c if t is not None else ():
            at = t.find(s, at)
            want.append(at)
            at += len(s)
    assert got.tolist() == want
    big = pa.array(["ab cd 漢字 ef" * 50] * 20)
    first, flat, lost = batches.flattened(big, pa.array([regex.findall("(?s).{1,5}", t) for t in big.to_pylist()]))
    monkeypatch.setattr(batches.np, "flatnonzero", lambda x: searched.append(int(np.sum(x))) or own(x))
    batches.places(big, flat, first, lost)
    assert searched[-1] == 0  # no text was left to search


def test_segments_come_as_rows(spark):
    df = spark.createDataFrame([(1, "a", "ab 漢字 cd"), (2, "b", None), (3, "c", "")], "k long, l string, text string")
    rows = segments_relation(df, P.fixed_length(3), unit="bytes")
    assert "Generate" not in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 0, "ab ", 0, 3), (1, "a", 1, "漢字 ", 3, 10), (1, "a", 2, "cd", 10, 12)]


def test_equal_hashes_of_different_parts_are_found_out(monkeypatch):
    model = merges(WORDS)
    texts = ["ab cab ba", "", None, "漢ab"]
    points = np.frombuffer("abbaab".encode("utf-32-le"), np.uint32)
    begin = np.array([0, 2, 4, 6])
    assert [(d, p.tolist()) for d, p in [piece_batches._numbered(points, begin)]][0][1] in ([0, 1, 0], [1, 0, 1])
    monkeypatch.setattr(piece_batches, "_BASE", 1)  # every order of the same characters is alike
    monkeypatch.setattr(piece_batches, "_INVERSE", 1)
    assert piece_batches._numbered(points, begin)[0] == ["ab", "ba"]
    check(model, texts)


def test_many_characters_are_looked_up_without_a_square(monkeypatch):
    model = merges(WORDS)
    monkeypatch.setattr(type(model), "SQUARE", 1)
    assert model._square is None
    check(model, ["ab cab ba", "", "漢ab é▁"])


def test_fresh_parts_equal_each_alone():
    draw, model = random.Random(8), merges([*WORDS, "aba", "bab", "abab", "▁aba"])
    parts = ["".join(draw.choice("▁abcxé漢") for _ in range(draw.randint(1, 40))) for _ in range(400)] + ["a\r\nb", "á", "ab" * 90]
    assert model.fresh_parts(parts) == [model.part(t) for t in parts]


def test_merging_together_takes_the_lowest_leftmost():
    draw = random.Random(2)
    rules = {(a, b): (k, 10 + k) for k, (a, b) in enumerate({(draw.randint(0, 20), draw.randint(0, 20)) for _ in range(120)})}
    rows = [[draw.randint(0, 5) for _ in range(draw.randint(1, 30))] for _ in range(100)]
    flat, row = np.array([x for r in rows for x in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    symbols, places = merging.merge_all(flat, row, merging.Pairs(rules))
    assert [symbols[row[places] == i].tolist() for i in range(len(rows))] == [[s for s, _, _ in merging.merge(r, lambda a, b: rules.get((a, b)))] for r in rows]


def test_words_are_counted_by_class(spark):
    text = "Été 漢字x1y_z ½ab\x1cc d　éf Ⅷ ٣ 𝒳y"
    for pattern in (r"\p{L}+", "[a-z]+", "[^b ]+", "[a-c]", r"\w+"):
        assert _finder(pattern)(text) == regex.findall(pattern, text), pattern
    df = spark.createDataFrame([(text,), (None,), ("",), ("ab ab",)], "text string")
    want = {}
    for w in regex.findall(r"\p{L}+", text) + ["ab", "ab"]:
        want[w] = want.get(w, 0) + 1
    assert {r.w: r.n for r in count_words(df, r"\p{L}+").collect()} == want


def test_truncated_ids_still_go_by_expressions(docs):
    spec = wordpiece()
    got = {r.k: r.ids for r in E.encode_to_ids(docs, spec, options=EncodeOptions(add_special_tokens=False)).collect()}
    assert got == {r.k: r.encoding and r.encoding.ids for r in E.encode(docs, spec, options=EncodeOptions(add_special_tokens=False)).collect()}
