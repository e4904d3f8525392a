"""Kernels over whole columns: as their row by row forms, with work for each distinct value once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import decoders
from tokenloom.kernels import merging
from tokenloom.kernels.alphabet import BYTE_TO_CHAR, to_alphabet
from tokenloom.kernels.bpe import Bpe, alphabet_bytes, from_alphabet
from tokenloom.kernels.byte_rank import ByteRank
from tokenloom.operators import decode as D
from tokenloom.operators import encode as E
from tokenloom.operators.words import count_words
from tokenloom.plans import models
from tokenloom.spec import AddedToken, BpeOptions, TokenizerSpec


def byte_models():
    chains = [w[:k] for w in (b"abab", b"bca", b" abc", "éa".encode()) for k in range(2, len(w) + 1)] + [b"ba", b"ab", b"ca"]
    ranks = {bytes([b]): b for b in range(256)}
    for c in chains:
        ranks.setdefault(c, len(ranks))
    rules = [(to_alphabet(c[:k]), to_alphabet(c[k:])) for c in chains for k in range(1, len(c))]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*BYTE_TO_CHAR.values(), *(a + b for a, b in rules)]))}
    return Bpe(vocab, rules, BpeOptions(byte_level=True)), ByteRank(ranks, ".+", {"<|x|>": 9999})


def test_parts_merged_together_equal_single_ones(monkeypatch):
    draw = random.Random(3)
    texts = list({"".join(draw.choice("abc é漢\r\ń") for _ in range(draw.randint(0, 40))) for _ in range(500)} | {"ab" * 200})
    bpe, rank = byte_models()
    want = [bpe.part(t) for t in texts], [rank.part((t, False)) for t in texts]
    assert rank.parts([(t, False) for t in texts] + [("<|x|>", True)]) == [*want[1], [(9999, "<|x|>", 0, 5)]]
    singles = []
    own = Bpe.segment
    bpe.part = lambda t: singles.append(t) or own(bpe, t)
    assert bpe.parts(texts) == want[0]
    assert all(len(t.encode()) > merging.MERGED_TOGETHER or not t or "\r" in t or "́" in t for t in singles)


def test_bytes_fall_back_in_columns():
    rows = [["<0xC3>", "<0xA9>", "a"], ["<0xC3>", "", "<0xA9>"], ["<0xC3>", "é", "<0xA9>"], [], None, ["<0xc3>", "<0x>"], ["<0xE2>", "<0x82>", "x", None, "<0xAC>"]]
    assert decoders.fall_back_column(pa.array(rows, pa.list_(pa.string()))).to_pylist() == [None if r is None else decoders.fall_back(r) for r in rows]


def test_alphabet_by_table():
    for t in ("", to_alphabet("né 漢".encode()), "漢" + to_alphabet(b"\xc3"), to_alphabet(bytes(range(256)))):
        assert from_alphabet(t) == alphabet_bytes(t).decode(errors="replace")


@pytest.mark.parametrize("skip", [True, False])
def test_columns_of_ids_equal_rows(skip):
    bpe, rank = byte_models()
    added = (AddedToken(900, "<s>", special=True), AddedToken(901, "##"))
    draw = random.Random(4)
    rows = [[draw.choice([*range(200), 900, 901, 9999, 5_000_000]) if k % 3 == 0 else draw.randrange(256) for _ in range(draw.randint(0, 30))] for k in range(60)] + [None, []]
    for spec in (TokenizerSpec("Bpe", bpe, added_tokens=added), TokenizerSpec("Tiktoken", rank), TokenizerSpec("Bpe", Bpe({"a</w>": 0}, [], BpeOptions(suffix="</w>")), added_tokens=added)):
        speller = D._Speller(spec)
        got = speller.column(pa.array(rows, pa.list_(pa.int32())), skip).to_pylist()
        assert got == [None if r is None else speller(r, skip) for r in rows]


def test_only_wanted_fields_are_carried(spark):
    spec = TokenizerSpec("Bpe", byte_models()[0])
    df = spark.createDataFrame([("abab c",), (None,), ("",)], "text string")
    whole = [r.encoding for r in E.encode(df, spec).collect()]
    rows = E.encode_fields(df, spec, ["ids", "tokens", "offsets"]).select("ids", "tokens", models._spots("offsets").alias("s"), models._ids("ids").alias("i")).collect()
    assert [r.ids for r in rows] == [None if e is None else e.ids for e in whole] and [r.tokens for r in rows] == [None if e is None else e.tokens for e in whole]
    assert [r.s for r in rows] == [None if e is None else " ".join(f"{o.start}:{o.end}" for o in e.offsets) for e in whole]
    assert [r.i for r in rows] == [None if e is None else " ".join(map(str, e.ids)) for e in whole]
    only = df.select(E.pieces(spark, spec, F.col("text"), None, ("ids",)).alias("p")).where("p.ids is not null").collect()
    assert all(r.p.tokens is None and r.p.offsets is None for r in only)


def test_batches_are_bounded_for_a_session(spark, tmp_path):
    other = spark.newSession()
    other.range(3).write.parquet(str(tmp_path / "t.parquet"))
    from tokenloom.sources.tables import table

    table(other, str(tmp_path), "t")
    assert int(other.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_words_are_counted(spark):
    df = spark.createDataFrame([("a bb a",), (None,), ("bb é",)], "text string")
    assert {r.w: r.n for r in count_words(df, "[a-z]+").collect()} == {"a": 2, "bb": 2}


def test_sequences_in_any_order(spark):
    from tokenloom.functions import encodings as X

    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4, 5],), (None,)], "ids array<int>")
    one = X.encoding({"ids": F.col("ids")})
    lit = lambda *r: {k: (F.lit(a), F.lit(b)) for k, a, b in r}
    for ranges in ([(0, 1, 3), (1, 3, 4)], [(1, 3, 4), (0, 0, 2)], [(0, 0, 9)], []):
        e = X.Enc(one.fields, None, lit(*ranges))
        for r in df.select("ids", X.sequence_ids(e).alias("s")).collect():
            assert r.s == (None if r.ids is None else [next((k for k, a, b in reversed(ranges) if a <= i < b), None) for i in range(len(r.ids))])
