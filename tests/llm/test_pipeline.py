"""The pipeline's stages, each on its own input, and the whole run against them."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from tokenloom.llm import toxicity


def lorem(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(200):
        words = lorem(40, i).split()
        if i % 5 == 0:
            words[7] = "moron"
        if i % 7 == 0:
            words[9] = f"u{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(300, rows[1][1], "en", "s", None), (300, rows[1][1], "en", "s", None), (301, None, None, None, None), (302, "", "en", "s", 0), (None, lorem(50, 999), "en", "s", 1), (303, lorem(9000, 5), "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    clean, single, private, packed = kept
    assert not any(i is not None and i < 200 and i % 5 == 0 for i in clean) and len(clean) == len(texts) - 40
    assert 300 not in single and 1 in single and (301 in single) != (302 in single) and None in single
    assert all("@mail.example.com" not in (r.text or "") for r in private.values()) and private.keys() == single.keys()
    assert all(r.text == texts[i] for i, r in private.items() if i is None or i % 7 or i > 200)
    assert packed.keys() == private.keys()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == packed.keys()


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_rejection_agrees_with_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    low = {r.doc_id for r in toxicity.score(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in toxicity.reject(docs, model).collect()} == low
