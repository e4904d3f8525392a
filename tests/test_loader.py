"""Rules of loading: inference, line ends, options, special tokens, own components."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.artifacts import loader
from tokenloom.functions import decoders, encodings, normalizers, pretokenizers
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.operators import decode as D
from tokenloom.operators import encode as E
from tokenloom.spec import AddedToken, TokenizerSpec

VOCAB = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] hello world ##s".split())}


@pytest.mark.parametrize(
    "model, backend",
    [
        ({"type": "WordLevel", "merges": ["a b"]}, "Unknown"),
        ({"type": " ", "merges": []}, "Bpe"),
        ({"merges": None}, "Bpe"),
        ({"continuing_subword_prefix": "x", "merges": None}, "Bpe"),
        ({"continuing_subword_prefix": "x", "merges": []}, "WordPiece"),
        ({"vocab": [["a", -1.0]]}, "Unknown"),
        ({"scores": None}, "SentencePieceUnigram"),
        ({}, "Unknown"),
    ],
)
def test_inferred_backends(model, backend):
    assert loader.infer_backend({"model": model}) == backend


def test_lines_end_at_line_ends_alone():
    text = "a b\r\nc\x0bd\re\x85f\ng \n"
    assert loader.read_vocab_text(text.encode()) == {"a b": 0, "c\x0bd": 1, "e\x85f": 2, "g": 3}
    assert loader.read_ranks("YQ== 0\r\nYg== 5\r".encode()) == {b"a": 0, b"b": 5}


def test_merge_options_of_the_config():
    o = loader.bpe_options({"continuing_subword_prefix": "##", "end_of_word_suffix": "</w>", "use_regex": False, "model_type": "gpt2", "unk_token": {"content": "<u>"}})
    assert (o.prefix, o.suffix, o.use_regex, o.byte_level, o.unk_token, o.add_prefix_space) == ("##", "</w>", False, True, "<u>", False)
    assert loader.bpe_options({"tokenizer_class": "GPT2Tokenizer"}).byte_level is False
    assert loader.bpe_options({"model_type": "roberta"}).add_prefix_space and not loader.bpe_options({"model_type": "roberta", "add_prefix_space": False}).add_prefix_space


def test_specials_of_post_processors_are_added_tokens():
    template = {"type": "TemplateProcessing", "single": [], "special_tokens": {"<s>": {"id": "<s>", "ids": [7], "tokens": ["<s>"]}}}
    both = {"type": "Sequence", "processors": [{"type": "ByteLevel"}, template, {"type": "BertProcessing", "cls": ["[C]", 8]}]}
    assert [(t.id, t.content, t.special) for t in loader.post_specials(both)] == [(7, "<s>", True), (8, "[C]", True), (102, "[SEP]", True)]
    root = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1}, "merges": []}, "post_processor": template, "added_tokens": [{"id": 7, "content": "<start>", "lstrip": True}]}
    spec = loader.from_tokenizer_json(json.dumps(root).encode())
    assert spec.added_tokens == (AddedToken(7, "<start>", lstrip=True, normalized=True, special=True),)


def test_json_reader_can_be_replaced(tmp_path):
    (tmp_path / "tokenizer.json").write_text("not json")
    root = {"model": {"type": "WordPiece", "vocab": VOCAB}}
    spec = loader.from_local(tmp_path, loader.LoadOptions(parse_json=lambda data: root))
    assert spec.backend == "WordPiece" and spec.model.vocab == VOCAB


def test_own_components(spark):
    double = lambda e: encodings.merge([e, e])
    spec = TokenizerSpec("WordPiece", WordPiece(VOCAB), normalizer=lambda c: F.lower(F.translate(c, "_", " ")), pre_tokenizer=lambda c: F.split(c, " "), post_processor=encodings.PostProcessor(double, lambda a, b: encodings.merge([a, b]), 0, 0), decoder=lambda t: F.array_join(t, "+"))
    row = E.encode(spark.createDataFrame([("Hello_World",)], "text string"), spec).first()
    assert row.encoding.ids == [4, 5, 4, 5] and [tuple(o) for o in row.encoding.offsets][:2] == [(0, 5), (6, 11)]
    assert D.decode(spark.createDataFrame([([4, 5],)], "ids array<int>"), spec).first().decoded == "hello+world"
    for module in (normalizers, pretokenizers, decoders):
        own = lambda c: c
        assert module.from_config(own) is own
