"""Collisions, file metadata, formats, wordings, long inputs, and every registered query."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import ann, common, licenses, media, neardup, pii, queries, token_store, toxicity
from tokenloom.llm.queries import PIECE_BPE, WORD_BPE

#: Two words of one hash (without a salt).
TWINS = ["photosynthesisxx", "fkfizvuczhkzlzfn"]


def _runs(words: list[bytes], dtype):
    data = np.frombuffer(b"".join(words), dtype)
    size = np.array([len(w) for w in words]) // data.dtype.itemsize
    return data, np.cumsum(size) - size, size


@pytest.mark.parametrize("dtype", [np.uint8, np.uint32])
def test_memo_tells_runs_of_one_hash_apart(dtype):
    calls = []

    def compute(runs):
        calls.extend(runs)
        return ([list(r) for r in runs],)

    words = [t.encode() for t in TWINS] + [b"abcdefgh", b"abcdefghijkl", b"abcd"]
    words = [w + w[: -len(w) % 4] for w in words] * 2
    for salt in (0, None):
        memo = common.Memo(compute, (np.int32,))
        memo.salt = memo.salt if salt is None else salt
        data, starts, sizes = _runs(words, dtype)
        if salt == 0 and dtype == np.uint8:
            assert common.run_hashes(data, starts, sizes)[0] == common.run_hashes(data, starts, sizes)[1]
        for _ in range(2):
            flat, ends = memo.pools[0].gather(memo.entries(data, starts, sizes))
            assert [bytes(flat[i:j].astype(np.uint8)) for i, j in zip(ends[:-1], ends[1:])] == words
    assert set(calls) == set(words)


def test_words_of_one_hash_are_other_ids_shingles_and_keys():
    from tokenizers import Tokenizer

    from tokenloom.llm.word_bpe import WordBpe

    coder, full = WordBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    coder.memo.salt = 0
    ids, off = coder.encode_column(pa.array([TWINS[0], TWINS[1], " ".join(TWINS)]))
    for i, t in enumerate([TWINS[0], TWINS[1], " ".join(TWINS)]):
        assert ids[off[i] : off[i + 1]].tolist() == full.encode(t, add_special_tokens=False).ids
    words = common.Words(pa.array(TWINS))
    assert len(set(neardup.shingles(words)[0].tolist())) == 2 and len(set(neardup.keys(words)[0].tolist())) == 2


def test_memo_forgets_beyond_its_bounds():
    memo = common.Memo(lambda runs: ([list(r) for r in runs],), (np.int32,), limit=3)
    for words in ([b"a", b"b", b"c", b"d"], [b"e", b"a"], [b"a", b"f"]):
        entries = memo.entries(*_runs(words, np.uint8))
        assert memo.pools[0].gather(entries)[0].tolist() == [w[0] for w in words]


def test_store_has_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    docs = spark.range(30_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    monkeypatch.setitem(token_store.OPTIONS, "orc.stripe.size", str(64 << 10))
    monkeypatch.setitem(token_store.OPTIONS, "orc.row.index.stride", "1000")
    shards = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    path = str(tmp_path / "store")
    token_store.write_token_store(docs, path, WORD_BPE)
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    (file,) = Path(path).glob("part-*")
    orc, conf = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), orc.readerOptions(conf))
    stripes, rows = reader.getStripes(), reader.rows()
    kinds = {s.getKind().toString() for s in rows.readStripeFooter(stripes.get(0)).getStreamsList()}
    assert stripes.size() > 1 and reader.getNumberOfRows() == 30_000 and reader.getRowIndexStride() == 1000
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    coded = {e.getKind().toString() for e in rows.readStripeFooter(stripes.get(0)).getColumnsList()}
    assert coded & {"DIRECT_V2"}  # run-length encoding of integers

    def scanned(ids):
        df = spark.read.schema(token_store.STORE).orc(path).where(F.col("doc_id").isin(ids))
        found = sorted(r.doc_id for r in df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return found, leaf.metrics().apply("numOutputRows").value()

    found, read = scanned([20_000])
    assert found == [20_000] and 0 < read < 30_000  # other stripes and row groups are skipped
    found, read = scanned([20_001])
    assert found == [] and read < 5_000  # within the range, but the Bloom filter tells
    assert [r.doc_id for r in token_store.read_token_store(spark, path, [20_000, 20_001]).collect()] == [20_000]


def _samples() -> dict[str, bytes]:
    ogg = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n"
    return {
        "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x04ef12\xff\x0034\xff\xd0\x05\xff\xd9",
        "image/bmp": b"BM" + struct.pack("<IIIIii", 62, 0, 54, 40, 1, 1) + bytes(36),
        "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
        "audio/ogg": ogg(2, b"abc") + ogg(4, b"de"),
        "application/pdf": pdf + b"trailer\nstartxref\n9\n%%EOF",
        "audio/wav": media.wav(b"\x80" * 10),
    }


@pytest.mark.parametrize("kind", sorted(_samples()))
def test_each_format_is_validated(kind):
    good = _samples()[kind]
    assert media.sniff(good) == (kind, [])
    assert media.sniff(b"head" + good + b"tail") == (media.UNKNOWN, [(kind, 4, len(good))])
    assert media.sniff(good[:-6])[0] == media.UNKNOWN and not media.sniff(good[:-6])[1]
    assert media.sniff(good[: len(good) // 3] + b"\xee" * 8 + good[len(good) // 3 + 8 :])[0] != kind or kind in ("image/bmp", "audio/ogg", "application/pdf", "image/jpeg")


def test_many_magic_bytes_take_linear_time():
    assert media.sniff(b"%PDF-1.4 " * 60_000)[0] == media.UNKNOWN
    data = b"%PDF-1." * 20_000 + b"x startxref\n3\n%%EOF"
    kind, inside = media.sniff(data)
    assert kind == "application/pdf" and len(inside) == 19_999


def test_features_of_a_value_that_is_no_sound(spark):
    rows = spark.createDataFrame([(1, 3, "audio/wav", bytearray(b"BM not sound")), (2, 0, "audio/wav", None)], "doc_id long, n_bytes long, declared string, media binary")
    for r in media.sample_features(rows).collect():
        assert r.payload_bytes == 0 and r.feature.startswith(f"{media.UNKNOWN};corrected=1;") and r.payload_sha256 == hashlib.sha256(b"").hexdigest()


@lru_cache
def _scanner() -> licenses.Scanner:
    return licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES + licenses.wordings())


def _labels(text: str, words: int = 0) -> set[str]:
    """Labels of what was found, of so many words at least."""
    return {label for label, _, a, b in _scanner().scan(common.Words(pa.array([text])))[0] if b - a >= words}


def test_whole_wordings_match_with_their_optional_parts_and_not_without_a_word():
    for label, marked in licenses.wordings():
        whole, body = re.sub("<<.*?>>", " ", marked), re.sub("(?s)<<beginOptional>>.*?<<endOptional>>", " ", marked)
        assert label in _labels(f"before {whole} behind", 900) and label in _labels(body, 900)
        words = body.split()
        assert label not in _labels(" ".join(words[:150] + words[151:]), 900)
    installed = {"Apache-2.0": "apache-2", "GPL-2": "gpl-2", "GPL-3": "gpl-3", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3", "MPL-2.0": "mpl-2", "CC0-1.0": "cc0"}
    for name, label in installed.items():
        path = Path("/usr/share/common-licenses") / name
        if path.exists():
            assert label in _labels(path.read_text(errors="replace"), 900)


def test_notices():
    gpl = "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    assert "gpl-3" in _labels(gpl, 60) and "gpl-3" not in _labels(gpl.replace("hope", "belief"), 60)
    assert "mpl-2" in _labels("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    assert "all-rights-reserved" in _labels("Copyright (c) 2020 Some Body. All rights reserved.") and not _labels("c the quick brown fox says all rights reserved")


def test_surrogates_of_very_long_entities(spark):
    r = np.random.default_rng(0)
    hexes = "".join(r.choice(list("0123456789abcdef"), 100_000))
    texts = [f"token = {hexes}", f"token = {'Zz9' * 40_000}==", f"{'ab1' * 40_000}@mail.example.com", f"Dr. {'Bacde' * 20_000} left", "Mr. Smith " * 10_000, "a@" * 50_000, "+1 555 123 4567 " * 6_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {x.doc_id: x for x in pii.replace(docs, spans="spans").collect()}
    for i, t in enumerate(texts):
        assert len(rows[i].text) == len(t) and (rows[i].text != t) == bool(rows[i].spans)
    assert [len(rows[i].spans) for i in range(7)] == [1, 1, 1, 1, 10_000, 0, 6_000]
    assert rows[0].text != pii.anonymize(texts[0], "another key")[0]


def test_long_permutations_keep_values_apart():
    bases = np.array([3, 3, 2, 2, 5])
    made = set()
    for x in np.ndindex(*bases):
        y = tuple(pii.permute_long(np.array(x), bases, "k").tolist())
        assert y != x and all(a < b for a, b in zip(y, bases))
        made.add(y)
    assert len(made) == bases.prod()
    long = ["z" * k + "0" * (300 - k) for k in range(300)]
    assert len({pii.surrogate("secret", t) for t in long}) == 300


def test_names_and_numbers_in_other_forms():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.detect(t)]
    assert kinds("John Smith lives here.") == [("name", "John Smith")]
    assert kinds("Contact: Maria Garcia") == [("name", "Maria Garcia")]
    assert kinds("dr smith") == [("name", "smith")]
    assert kinds("MR. SMITH met mr. smith") == [("name", "SMITH"), ("name", "smith")]
    assert kinds("call 017 555 7713 now") == [("phone", "017 555 7713")]
    assert kinds("reach 030 1234 5678.") == [] or kinds("reach 030 1234 5678 x") == [("phone", "030 1234 5678")]
    for plain in ("Mark my words", "miss the point", "dr and the", "In 2019 we had 017 items", "call it a day"):
        assert kinds(plain) == []
    a, b = pii.anonymize("MR. SMITH met mr. smith")[0].removeprefix("MR. ").split(" met mr. ")
    assert a.lower() == b


def test_components_of_paths_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_SHARE", 4)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(60)] + [(170, 100)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (100, 101)], "a long, b long")
    roots = {r.node: r.root for r in neardup.components(edges).collect()}
    assert {n for n, r in roots.items() if r == 0} == set(range(1, 41)) and {n for n, r in roots.items() if r == 100} == {*range(101, 161), 170}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).collect() == []
    monkeypatch.setattr(neardup, "TURNS", 1)
    with pytest.raises(RuntimeError):
        neardup.components(edges)


@pytest.mark.parametrize("n", [2_000, 8_000])
def test_recall_on_uniform_vectors_at_two_sizes(spark, n):
    v = np.random.default_rng(n).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = ann.self_search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    got: dict[int, set[int]] = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, n, 20):
        score = v @ v[q]
        score[q] = -9
        hits.append(len(got[q] & set(np.argpartition(-score, 20)[:20].tolist())) / 20)
    assert len(got) == n // 20 and all(len(x) == 20 for x in got.values()) and np.mean(hits) >= 0.9


def test_equal_vectors_and_ids_in_the_index(spark):
    r = np.random.default_rng(3)
    v = [(x / np.linalg.norm(x)).tolist() for x in r.normal(size=(1500, 8))]
    rows = [(i, v[i]) for i in range(1500)] + [(2000 + i, v[20]) for i in range(400)] + [(40, v[41]), (60, v[60])]
    out = ann.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    best = sorted((x["rank"], x.vec_id) for x in out if x.query_id == 2020)
    assert [i for _, i in best] == [20, *(2000 + i for i in range(20) if 2000 + i != 2020)][:20]
    assert sum(x.query_id == 40 for x in out) == 40 and sum(x.query_id == 60 for x in out) == 20  # two rows of one id, and one twice


# --- the registered queries -------------------------------------------------------------------

TEXTS = ["Released under the MIT License by John Smith, jo@mail.example.com", None, "", "you moron " * 3, "words and more words " * 900, "naïve café 中文 😀", "  two  spaces\n"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("queries")
    many = [(f"filler text number {i} says " + ("you moron" if i % 4 == 0 else "good day") + f" to {i * 7}") for i in range(120)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate([*TEXTS, TEXTS[4], *many])] + [(None, "a text without id", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bool(t) and "moron" in t)) for i, t, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    v = np.random.default_rng(5).normal(size=(400, 12))
    v[7] = v[3]
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)] + [(400, None, 0), (420, v[0].tolist(), 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d), [(i, t) for i, t, *_ in rows]


def _result(spark, sf, name, **kinds):
    df = queries.queries()[name](spark, sf[0])
    types = dict(df.dtypes)
    assert {k: types[k] for k in kinds} == kinds
    return df.collect()


def _ids(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def test_query_op1(spark, sf):
    rows = _result(spark, sf, "op1_best_fit_packing", doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    want = Counter()
    for i, t in sf[1]:
        ids = _ids(t)
        want.update((i, k, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) <= 4096


def test_query_op2(spark, sf):
    rows = _result(spark, sf, "op2_token_store", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    at = 0
    for (i, t), r in zip(sorted(sf[1], key=lambda x: -1 if x[0] is None else x[0]), sorted(rows, key=lambda r: r.start), strict=True):
        ids = _ids(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_query_op3(spark, sf):
    rows = {r.doc_id: r for r in _result(spark, sf, "op3_media_sniffing", doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")}
    for i, t in sf[1]:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        sound = media.wav(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(sound), hashlib.sha256(sound).hexdigest())
    assert rows[4].feature == rows[len(TEXTS)].feature and len(rows) == len(sf[1])


def test_query_op4(spark, sf):
    rows = {r.doc_id: r for r in _result(spark, sf, "op4_license_scan", doc_id="bigint", n_words="bigint", n_base="bigint", first_word="bigint", last_word="bigint", base_labels="string", labels="string", score="double")}
    assert (rows[0].n_base, rows[0].first_word, rows[0].base_labels, rows[0].labels) == (1, 1, "mit", "mit") and rows[0].score > 0
    assert all(r.n_base == 0 and r.first_word is None and r.base_labels == "" for i, r in rows.items() if i != 0) and len(rows) == len(sf[1])


def test_query_op5(spark, sf):
    rows = _result(spark, sf, "op5_permutation_index", query_id="bigint", rank="int", vec_id="bigint", score="double")
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf[0]}/embeddings.parquet").collect() if r.embedding}
    for q in (x for x in v if x % 20 == 0):
        best = sorted(((-float((v[i] * v[q]).sum()), i) for i in v if i != q))[:20]
        got = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [(k, i) for k, i, _ in got] == [(k + 1, i) for k, (_, i) in enumerate(best)] and np.allclose([s for *_, s in got], [-s for s, _ in best], rtol=1e-12)
    assert {r.query_id for r in rows} == {x for x in v if x % 20 == 0}


def test_query_op6(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rows = {r.doc_id: r for r in _result(spark, sf, "op6_piece_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")}
    for i, t in sf[1]:
        ids = sp.encode(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_query_op7(spark, sf):
    rows = {r.doc_id: r for r in _result(spark, sf, "op7_surrogates", doc_id="bigint", text="string")}
    for i, t in sf[1]:
        assert rows[i].text == (None if t is None else pii.anonymize(t)[0])
    assert "John Smith" not in rows[0].text and "jo@mail" not in rows[0].text and rows[6].text == TEXTS[6]


def test_query_op8(spark, sf):
    rows = {r.doc_id: r for r in _result(spark, sf, "op8_toxicity", doc_id="bigint", held_out="boolean", score="double", predicted="int")}
    for i, t in sf[1]:
        r = rows[i]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.predicted == int(bool(t) and "moron" in t)


def test_query_op9_and_op10(spark, sf):
    placed = _result(spark, sf, "op9_sharding", doc_id="bigint", slot="int", shard="int")
    assert len(placed) == len(sf[1]) and {r.shard for r in placed} <= set(range(32))
    classes = {r.doc_id: r.class_id for r in _result(spark, sf, "op10_dart_minhash", doc_id="bigint", class_id="bigint")}
    assert classes[len(TEXTS)] == 4 == classes[4] and classes[1] == classes[2] == 1 and classes[0] == 0 and len(classes) == len(sf[1])


# --- scores of toxicity by a plain way ----------------------------------------------------------


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def _plain_score(model: toxicity.Model, text: str) -> float:
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    used, misspelled, quoted_sum, aimed_count, strongest = 0.0, 0.0, 0.0, 0, 0.0
    for i, (w, begin, end) in enumerate(words):
        best = None
        for k, (term, stem) in enumerate(model.terms):
            allowed = 0 if stem else (len(term) >= 5) + (len(term) >= 9)
            if stem and w.startswith(term):
                best = min(best or (9,), (0, 1, -len(term), k))
            elif not stem and (d := _distance(w, term)) <= allowed:
                best = min(best or (9,), (d, 0 if d == 0 else 2, 0, k))
        if best is None:
            continue
        errors, weight = best[0], model.weights[best[3]]
        before = {x for x, *_ in words[max(0, i - 4) : i]}
        around = before | {x for x, *_ in words[i + 1 : i + 5]}
        ahead, behind = text[max(0, begin - 60) : begin].rpartition("\n")[2], text[end : end + 60].partition("\n")[0]
        quoted = ahead.count('"') % 2 == 1 and '"' in behind or bool(before & toxicity.REPORTING)
        if quoted:
            quoted_sum += weight
        elif errors:
            misspelled += weight
        else:
            used += weight
        aimed = bool(around & toxicity.ADDRESSING) and not quoted
        aimed_count += aimed
        strongest = max(strongest, 0.0 if quoted else weight * (0.5 if errors else 1.0))
    x = [np.log1p(used), np.log1p(misspelled), np.log1p(quoted_sum), np.log1p(aimed_count), strongest, np.log1p(used) / max(1, len(words)) * 10, np.log1p(len(words))]
    x[5] = used / max(1, len(words)) * 10
    return float(1 / (1 + np.exp(-np.clip(model.beta[0] + np.dot(model.beta[1:], x), -30, 30))))


def test_scores_equal_a_plain_way(spark):
    model = toxicity.Model([("moron", False), ("idiot", True), ("blockhead", False), ("fool", False)], [3.0, 2.0, 2.5, 1.5], [-1.0, 1.2, 0.7, -0.9, 0.4, 0.3, 0.2, -0.1])
    texts = ["you moron", "what a m0ron, morron and moroon", 'she said "moron" twice', "he called him a fool", "idiotic idiots everywhere\nyou", "blokheed blockhead", "", "plain words only here", "a fool\nand his money", "foool", "x " * 200 + "moron"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(_plain_score(model, t), rel=1e-9), t
