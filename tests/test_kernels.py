"""Kernels and loading, without Spark: small exact cases."""

from __future__ import annotations

import base64
import json
import random
import struct

import pytest

from tokenloom.artifacts import loader, registry
from tokenloom.artifacts import piece_model as pm
from tokenloom.kernels.alphabet import BYTE_TO_CHAR, CHAR_TO_BYTE, to_alphabet
from tokenloom.kernels.bpe import AddedTokens, Bpe, encode_with_added, from_alphabet
from tokenloom.kernels.byte_rank import ByteRank
from tokenloom.kernels.charsmap import CharsMap, build_charsmap
from tokenloom.kernels.merging import merge
from tokenloom.kernels.piece_models import PieceMerges, Unigram
from tokenloom.kernels.pieces import lower_each, text_elements
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.spec import AddedToken, BpeOptions, TokenizerNotSupported, WordPieceOptions


def ids(pieces):
    return [p.id for p in pieces]


def spans(pieces):
    return [(p.start, p.end) for p in pieces]


def test_alphabet_is_a_bijection():
    assert len(BYTE_TO_CHAR) == len(CHAR_TO_BYTE) == 256 and to_alphabet(b" \n") == "ĠĊ"
    assert all(from_alphabet(to_alphabet(bytes([0xC3, b]))) == bytes([0xC3, b]).decode(errors="replace") for b in range(256))


def test_merging_equals_a_full_scan_each_time():
    r = random.Random(0)
    for _ in range(300):
        rules = {("".join(r.choices("ab", k=r.randint(1, 2))), "".join(r.choices("ab", k=r.randint(1, 2)))): k for k in r.sample(range(50), 8)}
        text = r.choices("ab", k=r.randint(0, 12))
        want = list(text)
        while True:
            options = [(rules[p], i) for i, p in enumerate(zip(want, want[1:])) if p in rules]
            if not options:
                break
            i = min(options)[1]
            want[i : i + 2] = [want[i] + want[i + 1]]
        assert [s for s, _, _ in merge(text, lambda a, b: (rules[a, b], a + b) if (a, b) in rules else None)] == want


def test_wordpiece():
    vocab = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] hello world ##s".split())}
    m = WordPiece(vocab)
    assert ids(m.word("worlds")) == [5, 6] and spans(m.word("worlds")) == [(0, 5), (5, 6)]
    assert ids(m.word("worldx")) == [1] and spans(m.word("worldx")) == [(0, 6)] and ids(m.word("s" * 101)) == [1]
    assert [(p.id, p.start, p.word) for p in m.encode([("hello", 0), ("worlds", 6)])] == [(4, 0, 0), (5, 6, 1), (6, 11, 1)]
    assert len(m.encode([("hello", 0), ("worlds", 6)], 2)) == 2
    with pytest.raises(ValueError):
        WordPiece({"a": 0})


SUFFIXED = "[UNK] h e l o</w> he hel hell hello</w> w o r d</w> wo wor worl world</w>".split()
SUFFIX_RULES = [tuple(x.split()) for x in "h e,he l,hel l,hell o</w>,w o,wo r,wor l,worl d</w>".split(",")]


def test_bpe_with_word_ends():
    m = Bpe({t: i for i, t in enumerate(SUFFIXED)}, SUFFIX_RULES, BpeOptions("[UNK]", suffix="</w>"))
    found = m.encode("hello world")
    assert ids(found) == [8, 16] and spans(found) == [(0, 5), (6, 11)] and m.decode([8, 16]) == "hello world"
    assert 0 in ids(m.encode("xyz"))
    with pytest.raises(KeyError):
        Bpe({"a": 0}, []).encode("b")


BYTES = "h e l o Ġ t r he hel hell hello Ġt Ġthe Ġther Ġthere".split()
BYTE_RULES = [tuple(x.split()) for x in "h e,he l,hel l,hell o,Ġ t,Ġt he,Ġthe r,Ġther e".split(",")]


def test_byte_level_bpe():
    m = Bpe({t: i for i, t in enumerate(BYTES)}, BYTE_RULES, BpeOptions(byte_level=True))
    found = m.encode("hello there")
    assert ids(found) == [10, 14] and spans(found) == [(0, 5), (5, 11)] and m.decode([10, 14]) == "hello there"
    v = {t: i for i, t in enumerate("Ġ h e l o Ġh Ġhe Ġhel Ġhell Ġhello".split())}
    rules = [("Ġ", "h"), ("Ġh", "e"), ("Ġhe", "l"), ("Ġhel", "l"), ("Ġhell", "o")]
    found = Bpe(v, rules, BpeOptions(byte_level=True, add_prefix_space=True)).encode("hello")
    assert ids(found) == [9] and spans(found) == [(0, 5)]
    assert ids(Bpe({"a": 0, " ": 1, "b": 2}, [], BpeOptions(split_whitespace=False)).encode("a b")) == [0, 1, 2]
    assert spans(Bpe({c: i for i, c in enumerate(BYTE_TO_CHAR.values())}, [], BpeOptions(byte_level=True)).encode("é!")) == [(0, 1), (0, 1), (1, 2)]


@pytest.mark.parametrize(
    ("token", "vocab", "text", "lower", "want", "at"),
    [
        (AddedToken(99, "<mask>", normalized=False, special=True), "", "<mask>", False, [99], [(0, 6)]),
        (AddedToken(99, "day"), "d a y", "DAY", True, [99], [(0, 3)]),
        (AddedToken(99, "day", normalized=False), "D A Y", "DAY", True, [1, 2, 3], [(0, 1), (1, 2), (2, 3)]),
        (AddedToken(99, "cat", single_word=True), "c a t b o", "cat", False, [99], [(0, 3)]),
        (AddedToken(99, "cat", single_word=True), "c a t b o", "bobcat", False, [4, 5, 4, 1, 2, 3], None),
        (AddedToken(99, "<mask>", lstrip=True, rstrip=True, normalized=False, special=True), "h i t e", "hi <mask> te", False, [1, 2, 99, 3, 4], [(0, 1), (1, 2), (2, 10), (10, 11), (11, 12)]),
    ],
)
def test_added_tokens(token, vocab, text, lower, want, at):
    m = Bpe({t: i for i, t in enumerate(["[UNK]", *vocab.split()])}, [], BpeOptions("[UNK]"))
    found = encode_with_added(m, AddedTokens((token,), lower_each if lower else None), text)
    assert ids(found) == want and (at is None or spans(found) == at)
    assert all(p.word is None for p in found if p.id == 99)


def test_byte_ranks_and_specials():
    ranks = {bytes([b]): b for b in range(256)} | {b"he": 256, b"ll": 257, b"hell": 258, b"hello": 259}
    _, pattern, specials = registry.resolve("gpt2")
    m = ByteRank(ranks, pattern, specials)
    assert ids(m.encode("hello")) == [259] and m.decode(ids(m.encode("héllo 😀"))) == "héllo 😀"
    found = m.encode("a<|endoftext|>hell")
    assert ids(found)[0] == 97 and 50256 in ids(found) and ids(found)[-1] == 258
    assert m.decode([104, 50256, 105]) == "h<|endoftext|>i" and m.decode([104, 50256, 105], True) == "hi"
    assert spans(m.encode("é")) == [(0, 1), (0, 1)] and len(m.encode("hello hello", 1)) == 1


def test_registry():
    assert registry.resolve("GPT-4o")[0] == "o200k_base" and registry.resolve("gpt-4-0613")[0] == "cl100k_base" and registry.resolve("gpt-oss-20b")[0] == "o200k_harmony"
    assert registry.resolve("o200k_harmony")[2]["<|call|>"] == 200012 and len(registry.resolve("o200k_harmony")[2]) == 21 and len(registry.MODELS) == 49
    for bad in ("", None, "nothing"):
        with pytest.raises(TokenizerNotSupported):
            registry.resolve(bad)


def model(rows, kind=pm.UNIGRAM, **flags):
    flags = {"add_dummy_prefix": False, "remove_extra_whitespaces": False, "escape_whitespaces": False} | flags
    return pm.PieceModel(tuple(pm.Piece(i, t, s, k) for i, (t, s, k) in enumerate(rows)), kind, **flags)


HEAD = [("<unk>", 0.0, pm.UNKNOWN), ("<s>", 0.0, pm.CONTROL), ("</s>", 0.0, pm.CONTROL)]
UNIGRAM = [*HEAD, ("he", 4.0, pm.NORMAL), ("llo", 3.0, pm.NORMAL), ("world", 2.0, pm.NORMAL)]


def test_unigram():
    assert ids(Unigram(model(UNIGRAM)).encode("hello")) == [3, 4]
    assert ids(Unigram(model(UNIGRAM, remove_extra_whitespaces=True)).encode("   hello   ")) == [3, 4]
    dummy = [*HEAD, ("▁he", 4.0, pm.NORMAL), ("llo", 3.0, pm.NORMAL)]
    found = Unigram(model(dummy, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)).encode("hello")
    assert ids(found) == [3, 4] and [p.token for p in found] == ["▁he", "llo"]
    assert ids(Unigram(model(UNIGRAM, charsmap=build_charsmap({"é": "e"}))).encode("héllo")) == [3, 4]
    unknown = Unigram(model(UNIGRAM)).encode("hexx")
    assert ids(unknown) == [3, 0, 0] and unknown[1].token == "<unk>" and Unigram(model(UNIGRAM)).encode("") == []
    assert ids(Unigram(model([*UNIGRAM, ("z", 1.0, pm.NORMAL)]), id_offset=True).encode("hello")) == [3, 5]
    with pytest.raises(ValueError):
        Unigram(model(UNIGRAM, pm.BPE))


MERGED = [*HEAD, *((t, 0.0, pm.NORMAL) for t in "▁ h e l o he ll llo ▁he hello ▁hello".split())]


def test_piece_merges():
    m = PieceMerges(model(MERGED, pm.BPE, add_dummy_prefix=True))
    found = m.encode("hello")
    assert ids(found) == [13] and found[0].token == "▁hello" and spans(found) == [(0, 5)] and m.decode([13]) == "hello"
    assert ids(m.encode("")) == [3] and ids(PieceMerges(model(MERGED, pm.BPE)).encode("hello")) == [12]


def test_charsmap():
    fixed = struct.pack("<I", 0)
    assert CharsMap(build_charsmap({"é": "e", "éa": "X", "😀": ""})).normalize("aéa é😀!") == "aX e!"
    assert CharsMap(fixed).normalize("é") == "é"
    for bad in (b"", b"\1\0\0", struct.pack("<I", 99), struct.pack("<I", 3) + b"abc"):
        with pytest.raises(ValueError):
            CharsMap(bad)


def test_text_units():
    assert text_elements("é\r\n👍🏽") == ["é", "\r\n", "👍🏽"] and lower_each("İA") == "İa"


def test_readers():
    assert loader.read_vocab_text(b"a  \n\nb\na\n") == {"a": 3, "": 1, "b": 2}
    assert loader.read_merges(b"#v\n\na b\nc d e\nx\n") == [("a", "b"), ("c", "d")]
    b = base64.b64encode(b"hi").decode()
    assert loader.read_ranks(f"Capacity: 2\n{b} 7\n\n".encode()) == {b"hi": 7} and loader.read_ranks(b.encode()) == {b"hi": 0}
    with pytest.raises(ValueError):
        loader.read_ranks(b"?? x")
    with pytest.raises(ValueError):
        pm.parse_piece_model(b"\x0a\x7f")


WORDPIECE_JSON = {"model": {"type": "WordPiece", "vocab": {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "hello": 3}, "unk_token": "[UNK]"}}
BPE_JSON = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"id": 9, "content": "<x>", "special": True}]}


def write(d, **files):
    for name, data in files.items():
        (d / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())
    return d


def piece_bytes(kind=pm.UNIGRAM):
    text = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    rows = b"".join(text(1, text(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for t, s, k in UNIGRAM)
    return rows + text(2, bytes([3 << 3, kind])) + text(3, bytes([3 << 3, 0]))


def test_loading_order_and_fallback(tmp_path):
    d = write(tmp_path, vocab__txt=b"[UNK]\nhello", vocab__json={"a": 0}, merges__txt=b"")
    assert loader.from_local(d).backend == "WordPiece"
    write(d, a__model=piece_bytes())
    assert loader.from_local(d).backend == "SentencePieceUnigram"
    write(d, tokenizer__json=BPE_JSON)
    assert loader.from_local(d).backend == "Bpe" and loader.load(str(d)).added_tokens[0].id == 9
    write(d, tokenizer__json=b"{broken")
    assert loader.from_local(d).backend == "SentencePieceUnigram"
    with pytest.raises(ValueError):
        loader.from_local(d, loader.LoadOptions(fallback_to_other_variants=False))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        loader.from_local(tmp_path / "none")
    only = write(tmp_path / "none", gpt2__tiktoken="\n".join(base64.b64encode(bytes([b])).decode() for b in range(256)).encode())
    assert loader.from_local(only).backend == "Tiktoken"


def test_json_loading():
    assert loader.from_tokenizer_json(json.dumps(WORDPIECE_JSON).encode()).model.vocab["hello"] == 3
    spec = loader.from_tokenizer_json(json.dumps({"model": {"type": "Unigram"}, "truncation": {"max_length": 4}, "padding": {"strategy": {"Fixed": 6}, "pad_id": 1}}).encode(), piece_bytes())
    assert spec.backend == "SentencePieceUnigram" and spec.truncation.max_length == 4 and spec.padding.length == 6
    with pytest.raises(TokenizerNotSupported):
        loader.from_tokenizer_json(json.dumps({"model": {"type": "Unigram"}}).encode())
    assert loader.parse_truncation({"truncation": None}) is None and loader.create(WordPiece({"[UNK]": 0})).backend == "WordPiece"
    with pytest.raises(TokenizerNotSupported):
        loader.create(object())


def test_option_precedence():
    o = loader.wordpiece_options({"model": {"unk_token": "A"}, "unk_token": "B", "normalizer": {"type": "bert", "lowercase": False}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": {"prefix": "%%", "cleanup": False}, "post_processor": {"cls": ["C", 1], "sep": [2, "D"]}}, {"do_lower_case": True})
    assert o == WordPieceOptions("B", "%%", 100, True, False, False, "C", "D")
    assert loader.bpe_options({"model_type": "roberta"}) == BpeOptions(byte_level=True, add_prefix_space=True)
    json_bpe = loader.bpe_from_json({"model": {"vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel", "add_prefix_space": True}]}})
    assert json_bpe.options.byte_level and not json_bpe.options.add_prefix_space


def test_pretrained_goes_through_the_cache(tmp_path):
    asked = []

    def fetch(model_id, revision, name):
        asked.append(name)
        return json.dumps(BPE_JSON).encode() if name == "tokenizer.json" else None

    o = loader.LoadOptions(cache_dir=str(tmp_path), fetch=fetch)
    assert loader.load("https://huggingface.co/org/model/tree/main", o).backend == "Bpe" and asked[0] == "tokenizer.json"
    assert (tmp_path / "org--model--main" / "tokenizer.json").exists()
    assert loader.from_pretrained("org/model", None, loader.LoadOptions(cache_dir=str(tmp_path))).backend == "Bpe"
    assert loader.split_model_id("org/model@v2") == ("org/model", "v2")
    with pytest.raises(FileNotFoundError):
        loader.load("other/model", loader.LoadOptions(cache_dir=str(tmp_path)))


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 80)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True"
