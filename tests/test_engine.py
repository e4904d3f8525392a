"""Operators on tables, and every query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import glob
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import tokenloom.queries as engine
from tokenloom.artifacts import loader
from tokenloom.functions import decoders, encodings, normalizers, pretokenizers
from tokenloom.kernels.bpe import Bpe
from tokenloom.kernels.piece_models import Unigram
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.operators import decode as D
from tokenloom.operators import encode as E
from tokenloom.spec import AddedToken, BpeOptions, EncodeOptions, Padding, PaddingMode, TokenizerSpec, Truncation, TruncationMode
from tokenloom.streaming import encode_stream, write_encodings

SF = "/root/testdata/sf0.001"
VOCAB = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] hello world ##s".split())}
SPEC = TokenizerSpec("WordPiece", WordPiece(VOCAB))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert got
    if name not in engine.oracle_sql():
        return
    sql = duck.sql(engine.oracle_sql()[name])
    assert sorted(sql.columns) == cols
    want = sql.select(*[f'"{c}"' for c in cols]).fetchall()
    order = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=order) == sorted(want, key=order)


def encoded(spark, spec, text, pair=None, **more):
    df = spark.createDataFrame([(text, pair)], "text string, pair string")
    return E.encode(df, spec, pair="pair" if pair is not None else None, **more).first()["encoding"]


def test_wordpiece_encodings(spark):
    e = encoded(spark, SPEC, "Hello world")
    assert e.ids == [2, 4, 5, 3] and e.tokens == ["[CLS]", "hello", "world", "[SEP]"] and e.words == [None, 0, 1, None]
    assert [tuple(o) for o in e.offsets] == [(0, 0), (0, 5), (6, 11), (0, 0)] and e.special_tokens_mask == [1, 0, 0, 1]
    e = encoded(spark, SPEC, "hello", "world")
    assert e.ids == [2, 4, 3, 5, 3] and e.type_ids == [0, 0, 0, 1, 1] and {k: tuple(v) for k, v in e.sequence_ranges.items()} == {0: (1, 2), 1: (3, 4)}
    assert encoded(spark, SPEC, "x", options=EncodeOptions(add_special_tokens=False)).ids == [1]
    assert encoded(spark, SPEC, "").ids == [2, 3] and encoded(spark, SPEC, None) is None
    assert encoded(spark, SPEC, "hello world hello", options=EncodeOptions(max_length=3, truncation=TruncationMode.ONLY_FIRST)).ids == [2, 4, 5]
    assert encoded(spark, SPEC, "hello", options=EncodeOptions(max_length=5, padding=PaddingMode.MAX_LENGTH)).attention_mask == [1, 1, 1, 0, 0]
    assert E.encode(spark.createDataFrame([], "text string, encoding int"), SPEC).collect() == []


def test_settings_of_json_hold_for_piece_models_only(spark):
    t, p = Truncation(2), Padding(pad_id=7, pad_to_multiple_of=4)
    assert encoded(spark, SPEC.with_(truncation=t, padding=p), "hello world").ids == [2, 4, 5, 3]
    from tokenloom.artifacts import piece_model as pm

    m = pm.PieceModel(tuple(pm.Piece(i, x, s, k) for i, (x, s, k) in enumerate([("<unk>", 0.0, 2), ("he", 4.0, 1), ("llo", 3.0, 1)])), add_dummy_prefix=False)
    spec = TokenizerSpec("SentencePieceUnigram", Unigram(m), truncation=t, padding=p)
    e = encoded(spark, spec, "hellohello")
    assert e.ids == [1, 2, 7, 7] and e.attention_mask == [1, 1, 0, 0]


def test_batches_pad_to_their_longest(spark):
    df = spark.createDataFrame([(0, "hello"), (0, "hello world"), (1, "hello")], "b int, text string")
    rows = E.encode_batches(df, SPEC, F.col("b"), options=EncodeOptions(add_special_tokens=False, padding=PaddingMode.LONGEST)).orderBy("b", "text").collect()
    assert [r.encoding.ids for r in rows] == [[4, 0], [4, 5], [4]] and [r.encoding.attention_mask for r in rows] == [[1, 0], [1, 1], [1]]


def test_bpe_never_normalizes_text_but_added_tokens(spark):
    m = Bpe({"[UNK]": 0, "D": 1, "A": 2, "Y": 3}, [], BpeOptions("[UNK]"))
    spec = TokenizerSpec("Bpe", m, normalizer={"type": "Lowercase"}, added_tokens=(AddedToken(99, "day"),))
    assert encoded(spark, spec, "DAY").ids == [99] and encoded(spark, spec.with_(added_tokens=()), "DAY").ids == [1, 2, 3]


def test_decoding(spark):
    ids = spark.createDataFrame([([4, 5, 6],), ([2, 4, 77, 3],), (None,)], "ids array<int>")
    rows = D.decode(ids, SPEC, skip_special_tokens=True).collect()
    assert [r.decoded for r in rows] == ["hello worlds", "hello", None]
    bpe = TokenizerSpec("Bpe", Bpe({"a</w>": 0, "b</w>": 1}, [], BpeOptions(suffix="</w>")), added_tokens=(AddedToken(9, "<m>", special=True),))
    df = spark.createDataFrame([([0, 1, 9, 0],)], "ids array<int>")
    assert D.decode(df, bpe).first().decoded == "a b<m>a" and D.decode(df, bpe, skip_special_tokens=True).first().decoded == "a b a"


def test_components_from_json(spark):
    one = lambda fn, text: spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x
    n, p = normalizers.from_config, pretokenizers.from_config
    assert one(n({"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "Strip"}]}), " Hello ") == "hello"
    assert one(n({"type": "Replace", "pattern": "a", "content": "b"}), "aa") == "aa" and one(n({"type": "Prepend", "prepend": "x"}), "aa") == "aa"
    assert one(n({"type": "BertNormalizer", "lowercase": True, "clean_text": True}), "É\tA\x00 B") == "ea b"
    assert one(p({"type": "Whitespace"}), "a b  c") == [" ", "  "] and one(p({"type": "WhitespaceSplit"}), "a b  c") == ["a", "b", "c"]
    assert one(p({"type": "Split", "pattern": {"String": "-"}, "behavior": "MergedWithPrevious"}), "a-b") == ["a", "-", "b"]
    assert one(p({"type": "Split", "pattern": {"Regex": "-"}, "behavior": "Removed"}), "a-b") == ["a", "b"]
    assert one(p({"type": "nothing known"}), "a b") == ["a", "b"] and one(pretokenizers.split("-", "merged_with_next"), "ab") == []
    assert one(pretokenizers.split("-", "merged_with_next"), "a-b-c") == ["a-b", "-c"]
    tokens = lambda fn, t: spark.createDataFrame([(t,)], "t array<string>").select(fn(F.col("t")).alias("x")).first().x
    assert tokens(decoders.wordpiece(), ["i", "'", "ve", "do", "##ne", "it", "."]) == "i've done it."
    assert tokens(decoders.ctc(), ["a", "a", "<pad>", "a", "b", "|", "|", "."]) == "ab."
    assert tokens(decoders.byte_fallback, ["a", "<0xC3>", "<0xA9>", "<0xFF>"]) == "aé�"
    assert tokens(decoders.sequence([decoders.bpe("</w>")]), ["a</w>", "b</w>"]) == "ab"
    post = encodings.from_config({"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "</s>", "type_id": 0}}], "special_tokens": {"<s>": {"ids": [1], "tokens": ["<s>"]}, "</s>": {"ids": [2], "tokens": ["</s>"]}}})
    assert (post.added_single, post.added_pair) == (2, 4)


def test_pair_truncation_equals_the_loop(spark):
    cases = [(a, b, k) for a in range(6) for b in range(6) for k in range(9)]
    df = spark.createDataFrame(cases, "a int, b int, k int")
    made = lambda c: encodings.encoding({"ids": F.array_repeat(F.lit(1), F.col(c))})
    x, y = encodings.truncate_pair(made("a"), made("b"), F.col("k"))
    for r in df.select("a", "b", "k", encodings.size(x).alias("x"), encodings.size(y).alias("y")).collect():
        a, b = r.a, r.b
        while a + b > r.k:
            a, b = (a - 1, b) if a >= b else (a, b - 1)
        assert (r.x, r.y) == (a, b), r


def test_streams_take_the_same_plan(spark, tmp_path):
    spark.createDataFrame([("hello world",), (None,)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    write_encodings(encode_stream(stream, SPEC), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.encoding.ids if r.encoding else [] for r in rows) == [[], [2, 4, 5, 3]]


def test_plans_stay_in_one_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = E.encode(docs.select("doc_id", "text"), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_loaded_tokenizers_encode(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(VOCAB))
    assert encoded(spark, loader.from_local(tmp_path), "HELLO worlds").ids == [2, 4, 5, 6, 3]
