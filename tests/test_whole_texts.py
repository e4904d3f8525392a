"""Whole texts by every backend, against brute force over the fixture's own vocabularies."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import regex

import tokenloom.queries as engine
from tokenloom.kernels.alphabet import to_alphabet
from tokenloom.operators import encode as E
from tokenloom.plans import models

LONG = "le café déjà vu, 中文 then 42 ## words — naïve façade\n" * 40
TEXTS = [
    "Le café est déjà là, the café, then  the   CAFÉ!", "Ça coûte 1234,50 € — don't\tyou'll see\n\n中文字 ひらがな 한국", "the## then <|endoftext|> ##the", "été 👍🏽 😀 x", "", None, "   ", " \n ", "a" * 300,
    "“Größe” … l’été fini", LONG,
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def naive(symbols, made, rank):
    """Lowest rank first, leftmost of equals, looking at all neighbours each time."""
    symbols = list(symbols)
    while options := [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
        i = min(options)[1]
        symbols[i : i + 2] = [made(symbols[i], symbols[i + 1])]
    return symbols


def spots(text, sizes):
    """Spans of the text elements that pieces of so many UTF-8 bytes touch."""
    owner, at = [], 0
    for e in regex.findall(r"\X", text):
        owner += [(at, at + len(e))] * len(e.encode())
        at += len(e)
    ends = np.cumsum([0, *sizes]).tolist()
    return [(owner[a][0], owner[b - 1][1]) for a, b in zip(ends, ends[1:])]


def brute_bpe(model, spec, text):
    rank = {p: k for p, (k, _) in model.rules.items()}
    added, out, at = {t.content: t.id for t in spec.added_tokens}, [], 0
    for part in regex.split("(" + "|".join(map(regex.escape, added)) + ")", text):
        if part in added:
            out.append((added[part], part, at, at + len(part)))
        else:
            spot = at
            for seg in regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", part):
                tokens = naive(to_alphabet(seg.encode()), lambda a, b: a + b, rank)
                out += [(model.vocab[t], t, spot + a, spot + b) for t, (a, b) in zip(tokens, spots(seg, map(len, tokens)))]
                spot += len(seg)
        at += len(part)
    return out


def brute_tiktoken(model, spec, text):
    """Parts that begin before a special belong to the text before it, however far they reach."""
    out, at = [], 0
    specials = [m.span() for m in regex.finditer("|".join(map(regex.escape, model.specials)), text)]
    for a, b in [*specials, (len(text), len(text))]:
        for m in [m for m in regex.finditer(model.pattern.pattern, text, pos=at) if m[0] and m.start() < a]:
            tokens = [bytes([x]) for x in m[0].encode()]
            while ways := [(model.ranks[x + y], i) for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if x + y in model.ranks]:
                i = min(ways)[1]
                tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            out += [(model.ranks[t], t.decode(errors="replace"), m.start() + x, m.start() + y) for t, (x, y) in zip(tokens, spots(m[0], map(len, tokens)))]
        out += [(model.specials[text[a:b]], text[a:b], a, b)] if b > a else []
        at = b
    return out


def brute_unigram(model, spec, text):
    for a, b in models._MAPPED.items():
        text = text.replace(a, b)
    text = " ".join(text.split())
    text = "▁" + text.replace(" ", "▁") if text else ""
    score = {p.text: (np.float32(p.score), p.id) for p in model.model.pieces if p.type == 1}
    low = np.float32(min(x for x, _ in score.values()) - 10)
    best = [(np.float32(0), [])]
    for n in range(1, len(text) + 1):
        ways = [(best[k][0] + score[text[k:n]][0], k, score[text[k:n]][1]) for k in range(n) if text[k:n] in score]
        ways.append((best[n - 1][0] + low, n - 1, 0))
        total, k, piece = max(ways, key=lambda w: w[0])
        best.append((total, [*best[k][1], (piece, text[k:n] if piece else "<unk>")]))
    return best[-1][1]


def brute_merges(model, spec, text):
    text = "▁" + regex.sub(" +", " ", text).replace(" ", "▁")
    ids = {p.text: p.id for p in model.model.pieces}
    elements = [e if e in ids else "<unk>" for e in regex.findall(r"\X", text)]
    rank = {(a[:k], a[k:]): (i, k) for a, i in ids.items() for k in range(1, len(a)) if a[:k] in ids and a[k:] in ids}
    return [(ids[t], t) for t in naive(elements, lambda a, b: a + b, rank)]


BACKENDS = {"bpe": (models.bpe_spec, brute_bpe), "tiktoken": (models.tiktoken_spec, brute_tiktoken), "unigram": (models.unigram_spec, brute_unigram), "sp_bpe": (models.sp_bpe_spec, brute_merges)}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@pytest.mark.parametrize("name", BACKENDS)
def test_whole_texts_equal_brute_force(spark, sf, name):
    make, brute = BACKENDS[name]
    spec = make(spark, sf)
    rows = {r.doc_id: r for r in engine.queries()[f"{name}_encode_text"](spark, sf).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if t is None:
            assert rows[i].ids_md5 is None
            continue
        want = brute(spec.model, spec, t)
        assert (rows[i].n, rows[i].ids_md5, rows[i].tokens_md5) == (len(want), md5(" ".join(str(w[0]) for w in want)), md5(models.MARK.join(w[1] for w in want))), t
        if len(want[0] if want else ()) == 4:
            assert rows[i].offsets_md5 == md5(" ".join(f"{a}:{b}" for _, _, a, b in want)), t
        else:  # offsets of piece models are those of the source map
            assert rows[i].offsets_md5 == md5(" ".join(f"{p.start}:{p.end}" for p in spec.model.encode(t)))


def test_parts_of_a_batch_make_one_result(spark, sf):
    docs = spark.createDataFrame([(1, "the" + " x" * E.PART), (2, None), (3, ""), (4, "the café"), (5, "y" * (E.PART + 1))], "doc_id int, text string").coalesce(1)
    ids = {r.doc_id: r.ids for r in E.encode_to_ids(docs, models.bpe_spec(spark, sf)).collect()}
    assert [None if ids[k] is None else len(ids[k]) > 0 for k in (1, 2, 3, 4, 5)] == [True, None, False, True, True]
    assert len(ids[5]) == E.PART + 1 and len(ids[1]) >= E.PART


def test_all_ids_are_returned(spark, sf):
    spec = models.wordpiece_spec(spark, sf)
    ids = {r.doc_id: r.ids for r in engine.queries()["encode_to_ids_whole"](spark, sf).collect()}
    want = {r.doc_id: None if r.encoding is None else " ".join(map(str, r.encoding.ids)) for r in E.encode(spark.read.parquet(f"{sf}/documents.parquet"), spec).collect()}
    assert ids == want and len(ids[TEXTS.index(LONG)].split(" ")) > 400
    first = {r.doc_id: r.ids for r in engine.queries()["encode_to_ids"](spark, sf).collect()}
    assert all(v is None or v == " ".join(ids[k].split(" ")[:8]) for k, v in first.items())


def test_whole_texts_decode(spark, sf):
    got = lambda name: {r.doc_id: r.value for r in engine.queries()[name](spark, sf).collect()}
    given = dict(enumerate(TEXTS))
    plain = lambda t, *drop: t if t is None else regex.sub("|".join(map(regex.escape, drop)), "", t)
    assert got("decode_ids_bpe") == {k: plain(t, "<|endoftext|>") for k, t in given.items()}  # specials are skipped
    rank = got("decode_ids_tiktoken")
    assert {k: t for k, t in rank.items() if "<|" not in (given[k] or "")} == {k: t for k, t in given.items() if "<|" not in (t or "")}
    for name, (make, brute) in (("decode_ids_sentencepiece", BACKENDS["unigram"]), ("decode_ids_sp_bpe", BACKENDS["sp_bpe"])):
        spec = make(spark, sf)
        text_of = {p.id: p.text for p in spec.model.model.pieces}
        for k, v in got(name).items():
            assert v == (None if given[k] is None else "".join(text_of[w[0]] for w in brute(spec.model, spec, given[k])).replace("▁", " ").strip(" ")), given[k]


def test_pieces_stand_in_the_original_text(spark, sf):
    rows = engine.queries()["sp_offsets"](spark, sf).collect()
    spec = models.unigram_spec(spark, sf)
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.pos)
        assert [r.token for r in own] == [w[1] for w in (brute_unigram(spec.model, spec, t) if t else [])]
        if t and t == " ".join(t.split()) and not set(models._MAPPED) & set(t):  # nothing is moved by normalizing
            # by the rule of offsets the mark put before stands nowhere, and a piece of place 0 alone has the place behind it
            assert all(0 <= r.start < r.end <= len(t) and (r.token == "<unk>" or t[r.start : r.end] == r.token.replace("▁", "")) for r in own[2:] if r.token != "▁")


def test_unicode_forms_equal_pythons(spark):
    import unicodedata

    texts = ["Café ﬁ Å é ① ２ ½ 한글 ﷺ", "", None, "plain", "ẹ́"]
    from tokenloom.functions import normalizers

    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(normalizers.unicode_form(form)("t").alias("x")).collect()
        assert [r.x for r in rows] == [None if t is None else unicodedata.normalize(form, t) for t in texts]


def test_segments_with_places(spark):
    from pyspark.sql import functions as F

    from tokenloom.functions import pretokenizers as P
    from tokenloom.operators.segments import segments_relation

    texts = ["Hé, 漢字  a😀b!", "", None, "one", "  x  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for split in (P.bert, P.fixed_length(3), P.digits(), P.split("[a,]", "removed"), P.whitespace_gaps):
        for unit in ("characters", "bytes"):
            for r in segments_relation(df, split, unit=unit).collect():
                t = texts[r.k] if unit == "characters" else texts[r.k].encode()
                assert t[r.start : r.end] == (r.segment if unit == "characters" else r.segment.encode())
    kept = segments_relation(df, P.bert).groupBy("k").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "segment")))["segment"], "|").alias("s"))
    assert {r.k: r.s for r in kept.collect()} == {0: "Hé|,|漢字|a😀b|!", 3: "one", 4: "x"}
