"""The dealt operators against brute force, over tables with nulls, empty and long texts,
repeated rows and columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import ann, licenses, media, neardup, packing, pii, piece_bpe, sharding, token_store, toxicity
from tokenloom.llm.queries import PIECE_BPE, WORD_BPE

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, piece int, length long, item long, k1 long, own_id long, score double, label string, shard int, slot int, media string, `rows` int"


def table(spark, rows):
    """(doc_id, text) rows with further columns, some of them null."""
    full = [(i, t, None, "s", None if t is None else len(t), 7, 8, 9, 1, 2, 0.5, None, 3, 4, "x", 5) for i, t in rows]
    return spark.createDataFrame(full, CLASH)


def lorem(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


LONG = lorem(6000, 1)
ROWS = [
    (1, "Hello, World! It's 42 — naïve café"), (2, None), (3, ""), (None, "a text without an id"), (4, LONG), (5, lorem(40, 2)),
    (5, lorem(40, 2)), (6, lorem(40, 2).upper()), (7, "   \n\t "), (8, "<|endoftext|> 中文 😀 don't"), (-9, "x" * 500), (10, lorem(300, 3)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def word_ids(word_bpe, text):
    return np.array([*word_bpe.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def test_packing_holds_every_piece_once_and_without_gaps(docs, none, word_bpe):
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    want = Counter()
    for i, t in ROWS:
        ids = word_ids(word_bpe, t)
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[i, p // 4096, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, WORD_BPE).collect() == []


def test_packing_in_rounds_stays_near_the_bound(spark):
    r = np.random.default_rng(0)
    lengths = np.concatenate([r.integers(1, 4097, 300), r.integers(1400, 2800, 300), [4096, 4096]])
    items = spark.createDataFrame([(int(x), i) for i, x in enumerate(lengths)], "length long, item long")
    rows = packing.pack(items, 4096, 64).collect()
    assert sorted(x.item for x in rows) == list(range(len(lengths))) and max(x.round for x in rows) > 0
    fill = Counter()
    for x in rows:
        fill[x.sequence_id] += x.length
    alone = packing.best_fit_decreasing(lengths, 4096)[2]
    assert max(fill.values()) <= 4096 and len(fill) <= len(alone) * 1.02 + 1
    assert packing.lower_bound(lengths, 4096) <= len(alone)


def test_lower_bound_is_never_above_the_best_packing():
    r = np.random.default_rng(1)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # thresholds beat the sum
    for _ in range(200):
        lengths = r.integers(1, 101, r.integers(1, 30))
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= len(packing.best_fit_decreasing(lengths, 100)[2])


def test_token_store_reads_back_what_was_written(spark, docs, none, word_bpe, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_token_store(docs, path, WORD_BPE)
    rows = token_store.with_crc(token_store.read_token_store(spark, path)).orderBy("start").collect()
    ids = [word_ids(word_bpe, t) for _, t in ROWS]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(ROWS, ids, strict=True))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    order = [float("-inf") if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    some = token_store.read_token_store(spark, path, [5, 10, 77]).collect()
    assert sorted(r.doc_id for r in some) == [5, 5, 10]
    empty = str(tmp_path / "empty")
    token_store.write_token_store(none, empty, WORD_BPE)
    assert token_store.read_token_store(spark, empty).collect() == []


def test_word_bpe_equals_the_library_on_odd_texts(word_bpe):
    import pyarrow as pa

    from tokenloom.llm.word_bpe import word_bpe as coder

    r = random.Random(3)
    signs = [*"aAbZ éÉ×÷ß'<|>0 9½²٣\n\t\r\x0b\x1c\x1f\x85\xa0　́İıΣσςẞ中ひ한\x00\x7f.,-_!“”😀‍", "<|endoftext|>", "'LL", "don't", "É"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, ""]
    ids, off = coder(WORD_BPE).encode_column(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == word_bpe.encode(t or "", add_special_tokens=False).ids


def test_media_column_is_lossless(docs, none):
    rows = media.sample_features(media.store(docs)).collect()

    def want(t):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media.wav(payload)).hexdigest()

    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows) == Counter((i, *want(t)) for i, t in ROWS)
    assert all(r.feature.startswith("audio/wav;") for r in rows)
    assert media.sample_features(media.store(none)).collect() == []


def _png() -> bytes:
    part = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"


def test_sniffing_corrects_types_and_carves(spark):
    png, sound = _png(), media.wav(b"\x80" * 64)
    broken = bytearray(png)
    broken[20] ^= 1
    values = [("image/gif", png), ("audio/wav", sound), ("image/png", bytes(broken)), (None, b"BM nothing GIF89a %PDF-"), ("text/plain", b"head" + GIF + b"mid" + png + b"end"), ("image/png", None), ("image/png", b"")]
    rows = media.sniff_column(spark.createDataFrame(values, "declared string, media binary")).collect()
    assert [r.media_type for r in rows] == ["image/png", "audio/wav", *[media.UNKNOWN] * 5]
    assert [r.corrected for r in rows] == [True, False, True, False, True, True, True]
    spans = rows[4].embedded
    assert [(s.type, s.offset) for s in spans] == [("image/gif", 4), ("image/png", 7 + len(GIF))]
    assert media.carve(rows[4].media, spans[1].offset, spans[1].length) == png
    assert not rows[2].embedded and not rows[3].embedded


def test_license_places_against_brute_force(spark, none):
    texts = ["Released under the MIT License. under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0 and cc by nc", None, "", "under the", "under the mit", "the mit license under", LONG, "UNDER the\nMIT license"]
    rows = licenses.summarize(licenses.scan_licenses(table(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r.labels.split(",") if r.labels else []) and 0 <= r.score <= 1
    assert licenses.summarize(licenses.scan_licenses(none)).collect() == []


def test_templates_need_their_mandatory_words():
    found = lambda t, text: {x[0] for one in licenses.Scanner({}, t).scan(_words(text)) for x in one}
    t = [("a", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four <<var;most=2>> five <<any;six|seven eight>>")]
    for ok in ("one four five six", "one two four x five six", "one two three four x y five seven eight"):
        assert found(t, f"zero {ok} nine") == {"a"}
    for bad in ("one three four five six", "one four x y z five six", "one four five", "one two three five six"):
        assert found(t, bad) == set()
    mit = next(text for label, text in licenses.TEMPLATES if label == "mit" and "hereby" in text)
    whole = re.sub("<<.*?>>", " ", mit)
    assert found(licenses.TEMPLATES, whole) == {"mit"} and found(licenses.TEMPLATES, whole.replace("sublicense", "licence")) == set()
    with pytest.raises(ValueError):
        licenses.Automaton([("a", "x <<beginOptional>> y", 0)])


def _words(text):
    import pyarrow as pa

    from tokenloom.llm.common import Words

    return Words(pa.array([text]))


def test_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(3000, 16)) * r.uniform(0.5, 2, (3000, 1))
    v[77] = v[40]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [None] * 16, 1), (5060, [float("nan")] * 16, 1), (5080, [float("inf")] * 16, 1), (5100, [1.0] * 3, 1), (None, v[1].tolist(), 1), (40, v[40].tolist(), 1), (5120, [], 1)]
    out = ann.self_search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")).toPandas()
    assert set(out.query_id) == set(range(0, 3000, 20)) and (out.groupby("query_id").size() == 20).all()
    hits = []
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        score = v @ v[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        hits.append(len(set(best) & set(g.vec_id)) / 20)
        assert np.allclose(g.score, [score[i] for i in g.vec_id], rtol=1e-12) and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    assert np.mean(hits) >= 0.9
    few = ann.self_search(spark.createDataFrame(rows[:6], "vec_id long, embedding array<double>, rank int")).collect()
    assert len(few) == 5
    assert ann.self_search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_piece_bpe_equals_the_library(docs, none):
    import pyarrow as pa
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    r = random.Random(5)
    signs = [*"aAbZ éß'<>0\n\t\r\xa0　́中ひ한\x00.,“😀▁ ", "<s>", "<0x0A>", "   ", "the", "ing", '");', "http://"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(2000)] + [None, "", " ", "a" * 4000]
    ids, off, back, ends = piece_bpe.piece_bpe(PIECE_BPE).code_column(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = lib.encode(t or "")
        assert ids[off[i] : off[i + 1]].tolist() == want and back.tobytes()[ends[i] : ends[i + 1]].decode() == lib.decode(want)
    rows = piece_bpe.digests(piece_bpe.encode_decode(docs, PIECE_BPE)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter(tuple(r) for r in rows) == Counter((i, len(x := lib.encode(t or "")), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, t in ROWS)
    assert piece_bpe.encode_decode(none, PIECE_BPE).collect() == []


PRIVATE = 'Mail jo.doe@mail.example.com or JO.DOE@mail.example.com, call +1 (017) 555-7713; ip 8.196.197.208, card 4111 1111 1111 1111, 9807915762804490, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Mr. John Smith met Mrs. Mary Jones; Smith left. DE89370400440532013000 ssn 123-45-6789'


def test_surrogates_keep_shape_and_identity(spark, docs, none):
    text, spans = pii.anonymize(PRIVATE)
    assert Counter(s["kind"] for s in spans) == Counter(email=2, phone=1, ip=1, card=2, secret=1, name=3, iban=1, ssn=1)
    made = [text[s["start"] : s["end"]] for s in spans]
    for _, a, b in pii.detect(PRIVATE):
        assert PRIVATE[a:b] not in made
    low, high = made[0], made[1]
    assert low.lower() == high.lower() and high.startswith(high.split("@")[0].upper())
    names = [m for m, s in zip(made, spans, strict=True) if s["kind"] == "name"]
    assert names[0].split()[1] == names[2]  # the surname alone is the same person
    assert names[0].split()[0].lower() in pii.NAMES["m"] and names[1].split()[0].lower() in pii.NAMES["f"]
    card = re.sub(r"\D", "", next(m for m, s in zip(made, spans, strict=True) if s["kind"] == "card"))
    assert pii.luhn(card[:-1]) == int(card[-1]) and pii.anonymize(PRIVATE)[0] == text != pii.anonymize(PRIVATE, "other key")[0]
    assert pii.anonymize("Version 1.2.3 of 2020-01-01 costs 3.14 and 1,000.") == ("Version 1.2.3 of 2020-01-01 costs 3.14 and 1,000.", [])
    mixed = table(docs.sparkSession, [*ROWS, (11, PRIVATE), (11, PRIVATE)])
    rows = pii.replace(mixed).collect()
    assert [r.doc_id for r in rows] == [i for i, _ in ROWS] + [11, 11] and rows[-1].text == rows[-2].text == text and rows[-1].n_chars == len(text)
    assert [r.text for r in rows[: len(ROWS)]] == [t for _, t in ROWS] and rows[0].asDict().keys() == set(mixed.columns)
    assert pii.replace(none).collect() == []


def test_secrets_of_letters_alone_are_found(monkeypatch):
    texts = [f"see {x} there" for x in ("AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghij" * 3, "gho_" + "ABCDEFGHIJ" * 2, "sk-" + "abcdefghij" * 3, "abcdef" * 6)]
    for t in texts:
        assert [(k, t[a:b]) for k, a, b in pii.detect(t)] == [("secret", t[4:-6])] and t[4:-6] not in pii.anonymize(t)[0]
    found = [pii.detect(t) for t in [*texts, PRIVATE, "nothing here", "Dr. Who", "ask-me AKIA sk-"]]
    monkeypatch.setattr(pii, "_LIKELY", re.compile(""))  # the prefilter hides nothing
    assert found == [pii.detect(t) for t in [*texts, PRIVATE, "nothing here", "Dr. Who", "ask-me AKIA sk-"]]


def test_surrogates_are_permutations(spark):
    for n in (2, 7, 1000):
        made = [pii.permute(i, n, "k") for i in range(n)]
        assert sorted(made) == list(range(n)) and all(a != b for a, b in enumerate(made))
    for kind, values in (("ssn", [f"{i:03d}-45-6789" for i in range(1000)]), ("card", [f"98079157628{i:05d}" for i in range(2000)]), ("ip", [f"10.0.{i // 256}.{i % 256}" for i in range(1000)]), ("email", [f"u{i}@a.org" for i in range(1000)]), ("name", [f"Ab{c}{d}e" for c in "bcdfgklm" for d in "aeiou"])):
        rows = [(kind, v, pii.surrogate(kind, v)) for v in values]
        assert len({r[2] for r in rows}) == len(values)
    assert pii.collisions(spark.createDataFrame(rows, "kind string, entity string, surrogate string")).collect() == []


def test_entities_of_all_documents_keep_apart(spark):
    body = "370400440532013000"
    short = ["".join((a, b, c)) for a in "BDFMPR" for b in "aeiou" for c in "aeiou"] + ["Ann", "Ian", "Li", "Ça", "ÇA", "ßa", "SSA"]
    values = {
        "iban": [f"DE{c:02d}{body[:-2]}{d:02d}" for c in range(100) for d in range(20)] + ["DE89 3704 0044 0532 0130 00", "DE8٩370400440532013000"],
        "ip": [f"{z}10.0.{i}.{'0' * (i < 10)}{i}" for z in ("", "0") for i in range(256)] + [f"8.8.{i}.8" for i in range(256)] + ["08.8.8.8", "8.08.8.8", "8.8.8.008", "٨.8.8.8"],
        "card": ["4111111111111111", "4111 1111 1111 1111", "٤111111111111111"],
        "secret": [f"{a}bcdef{b}{d}" for a in "bcdfghjklm" for b in "aeiouy" for d in range(40)],
        "email": ["İa@b.org", "ÇA@b.org", "ßA@b.org", "sse@b.org", "ςa@b.org"],
        "name": short + [n.capitalize() for names in pii.NAMES.values() for n in names] + [f"{a}{b}na" for a in "BDFGHLM" for b in "aeiou" if f"{a}{b}na".lower() not in pii._NAME_LIST],
    }
    rows = [(k, v, pii.surrogate(k, v)) for k, some in values.items() for v in some]
    assert pii.collisions(spark.createDataFrame(rows, "kind string, entity string, surrogate string")).collect() == []
    assert all(pii.fold(v) != pii.fold(x) and (k == "ip" or v.lower() in pii._NAME_LIST or len(v) == len(x)) for k, v, x in rows)
    assert all(max(map(int, x.split("."))) < 256 for k, v, x in rows if k == "ip")
    assert all(x.lower() not in pii._NAME_LIST for k, v, x in rows if k == "name" and v.lower() not in pii._NAME_LIST)
    valid = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 and 2 <= int(t[2:4]) <= 98
    assert all(valid(v.replace(" ", "")) == valid(x.replace(" ", "")) for k, v, x in rows if k == "iban")
    # an entity has one surrogate, whatever stands beside it
    listed = [v for v in values["iban"] if " " not in v][:50]
    text, spans = pii.anonymize("; ".join(listed))
    assert [text[s["start"] : s["end"]] for s in spans] == [pii.anonymize(v)[0] for v in listed]


def test_levenshtein_trie_against_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if (old := row) else []
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    terms = ["idiot", "scum", "disgusting", "moron", "clown"]
    lexicon = toxicity.Lexicon([*((t, False) for t in terms), ("réeux", True)])
    r = random.Random(7)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "i", "s", "x"])
        w = "".join(w)
        near = [d for t in terms if (d := distance(w, t)) <= lexicon.allowed(t)]
        found = lexicon.read(w)
        assert (found is None) == (not near) and (found is None or found[1] == min(near))
    assert lexicon.read("réeuxment") == (5, 0) and lexicon.read("réeu") is None


def test_toxicity_learns_and_never_reads_held_out_labels(spark, none):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = lorem(30, i).split()
        if toxic:
            words[r.randint(5, 25)] = r.choice(["moron", "idiot", "scum", "idi0t"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = table(spark, rows + [(None, None), (601, ""), (0, rows[0][1])])
    known = spark.createDataFrame(labels + [(None, 1, 1), (602, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.predict(docs, known).collect()
    assert len(out) == 603 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    held = [x for x in out if x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert all(x.held_out for x in held) and sum(x.held_out for x in out) == len(held) + (zlib.crc32(b"") % 4 == 2)
    right = [x.predicted == int(x.doc_id % 5 == 0) for x in held if x.doc_id < 600]
    assert np.mean(right) > 0.95
    flipped = known.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(x.doc_id, x.score) for x in toxicity.predict(docs, flipped).collect()}
    assert again == {(x.doc_id, x.score) for x in out}
    model = toxicity.train(docs, known)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in out if x.score < 0.3}
    assert toxicity.predict(none, known).collect() == [] and toxicity.predict(docs, known.limit(0)).where("predicted = 1").collect() == []


def test_quoted_terms_count_apart():
    import pyarrow as pa

    scorer = toxicity.Scorer(toxicity.Model([("idiot", False)], [5.0], [], 0.1))
    _, spans = scorer.spans(pa.array(['you idiot', 'he said "idiot" loudly', "they called him idiot then", "plain ldiot here", None]))
    assert [[s[1:] for s in one] for one in spans] == [[(1, False, True)], [(1, True, True)], [(1, True, True)], [(-1, False, False)], []]


def test_sharding_fills_by_turns(spark, docs, none):
    names, slots = sharding.shard_names(5), 101
    table_, free = [-1] * slots, set(range(slots))
    orders = [[(o + j * k) % slots for j in range(slots)] for o, k in (sharding.preference(n, slots) for n in names)]
    for turn in range(slots):
        s = next(s for s in orders[turn % 5] if s in free)
        free.remove(s)
        table_[s] = turn % 5
    assert sharding.fill_table(names, slots) == table_
    out = sharding.assign(docs, "doc_id", names, slots).collect()
    want = {i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % slots for i, _ in ROWS}
    assert len(out) == len(ROWS) and all(r.slot == want[r.doc_id] and r.shard == table_[r.slot] for r in out)
    assert sharding.assign(none, "doc_id").collect() == []
    fewer = sharding.fill_table(names[:4], slots)
    assert sum(a != b for a, b in zip(table_, fewer, strict=True) if a != 4) < slots * 0.25
    for bad in (100, 3):
        with pytest.raises(ValueError):
            sharding.fill_table(names, bad)


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 9, 400).astype(float)
    b = np.where(r.random(400) < 0.2, r.integers(0, 9, 400), a)
    shares = []
    for seed in range(30):
        h = neardup.splitmix(np.arange(400, dtype=np.uint64) + np.uint64(seed * 1000))
        sig = neardup.dart_minhash(np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.array([0, (a > 0).sum(), (a > 0).sum() + (b > 0).sum()]))
        shares.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(shares) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def _classes(rows):
    """Connected parts of the pairs of similarity 0.8 or more."""
    fold = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def _edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "zz" + str(r.random())[2:8]
    return " ".join(words)


def test_near_duplicates_against_brute_force(spark, none, monkeypatch):
    base = [lorem(200, 100 + k) for k in range(6)]
    rows = [*ROWS, *[(100 + k, _edited(base[k % 6], (0, 1, 2, 3, 6, 30)[k // 6 % 6], k)) for k in range(90)], (300, base[0]), (300, base[0]), (None, base[1]), (301, None), (302, "a b c d"), (303, "A, b; c. D")]
    docs = table(spark, rows)
    roots = _classes(rows)
    want = {}
    for (i, _), r in zip(rows, roots, strict=True):
        want[r] = min(x for x in (want.get(r), i) if x is not None) if not (want.get(r) is None and i is None) else None
    expect = Counter((i, want[r]) for (i, _), r in zip(rows, roots, strict=True))
    assert Counter(map(tuple, neardup.near_duplicates(docs).collect())) == expect
    monkeypatch.setattr(neardup, "PART_BYTES", 4000)  # large groups in parts give the same
    monkeypatch.setattr(neardup, "SIGNATURE_BYTES", 2000)
    assert Counter(map(tuple, neardup.near_duplicates(docs).collect())) == expect
    kept = neardup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(roots)) and Counter(got) == Counter(want.values())
    assert neardup.near_duplicates(none).collect() == [] and neardup.drop_copies(none).collect() == []


def test_shingles_can_weigh_by_their_counts(spark):
    chorus, rest = lorem(30, 7), [lorem(60, 8 + k) for k in range(3)]
    rows = [(1, " ".join([chorus] * 9 + [rest[0]])), (2, " ".join([chorus] * 2 + [rest[0]])), (3, " ".join([chorus] * 8 + [rest[0]])), (4, rest[1]), (5, rest[1] + " zz"), (6, rest[2]), (7, ""), (8, None), (9, "a b"), (10, "a b a b")]
    def bag(t):
        w = WORD.findall(t or "")
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    def brute(weigh):
        bags, root = [Counter(set(bag(t))) if not weigh else bag(t) for _, t in rows], {i: i for i, _ in rows}
        for (i, _), a in zip(rows, bags):
            for (j, _), b in zip(rows, bags):
                if a == b or (a & b).total() >= 0.8 * (a | b).total():
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if r == high else r for k, r in root.items()}
        return root

    assert brute(True) != brute(False)  # counts tell text 2 from 1 and 3
    docs = table(spark, rows)
    for weigh in (False, True):
        assert dict(map(tuple, neardup.near_duplicates(docs, weighted=weigh).collect())) == brute(weigh)
        assert Counter(r.doc_id for r in neardup.drop_copies(docs, weighted=weigh).collect()) == Counter(set(brute(weigh).values()))


def test_tokenizer_files_are_found():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_BPE
