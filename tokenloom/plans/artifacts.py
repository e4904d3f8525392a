"""Queries of the artifact readers, over artifacts made from the tables of regions and nations
(5 and 25 rows at every scale, so the driver may hold them)."""

from __future__ import annotations

import base64
import json
import struct
import tempfile
from pathlib import Path

from tokenloom import sources
from tokenloom.artifacts.loader import infer_backend


def _names(spark, sf_dir) -> list[str]:
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_name").collect()]


def vocab_scan(spark, sf_dir):
    return sources.vocabulary(spark, "\n".join(f"{n}  " for n in _names(spark, sf_dir)).encode())


def merges_scan(spark, sf_dir):
    lines = ["#version: 0.2", "", *(f"{n[0]} {n[1:].replace(' ', '_')} extra" for n in _names(spark, sf_dir))]
    return sources.merges(spark, "\n".join(lines).encode())


def tiktoken_scan(spark, sf_dir):
    lines = [f"{base64.b64encode(n.encode()).decode()} {i * 2}" for i, n in enumerate(_names(spark, sf_dir))]
    out = sources.ranks(spark, "\n".join(["Capacity: 25", "", *lines]).encode())
    return out.selectExpr("decode(bytes, 'UTF-8') as token", "rank")


def _field(number: int, data: bytes) -> bytes:
    size, head = len(data), bytes([number << 3 | 2])
    return head + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + data


def sp_pieces_scan(spark, sf_dir):
    piece = lambda i, n: _field(1, _field(1, n.encode()) + b"\x15" + struct.pack("<f", -float(i)) + (b"\x18\x02" if not i else b""))
    return sources.pieces(spark, b"".join(piece(i, n) for i, n in enumerate(_names(spark, sf_dir))))


def artifact_discovery(spark, sf_dir):
    with tempfile.TemporaryDirectory() as d:
        for name in ("b.model", "a.model", "merges.txt", "vocab.json", "vocab.txt", "x.tiktoken", "readme.md", "tokenizer.json"):
            (Path(d) / name).write_text("")
        return sources.variants(spark, d)


#: Descriptions of models and the backends that they mean.
MODELS = [
    ({"type": "WordPiece"}, "WordPiece"),
    ({"type": "BPE"}, "Bpe"),
    ({"type": "Unigram"}, "SentencePieceUnigram"),
    ({"type": "SentencePieceBPE"}, "SentencePieceBpe"),
    ({"continuing_subword_prefix": "##", "merges": ["a b"]}, "WordPiece"),
    ({"continuing_subword_prefix": "##"}, "WordPiece"),
    ({"continuing_subword_prefix": "", "merges": ["a b"]}, "Bpe"),
    ({"merges": []}, "Bpe"),
    ({"merges": None}, "Bpe"),
    ({"scores": [-1.0]}, "SentencePieceUnigram"),
    ({"vocab": [["a", -1.0]]}, "Unknown"),
    ({"type": "WordLevel", "merges": []}, "Unknown"),
    ({"type": "sentencepiece_bpe"}, "SentencePieceBpe"),
    ({"continuing_subword_prefix": "@@", "merges": []}, "WordPiece"),
    ({"continuing_subword_prefix": "@@", "merges": None}, "Bpe"),
    ({"vocab": {}}, "Unknown"),
]


def backend_inference(spark, sf_dir):
    rows = [(i, json.dumps(m, sort_keys=True), infer_backend({"model": m})) for i, (m, _) in enumerate(MODELS)]
    return spark.createDataFrame(rows, "n int, model string, backend string")


_NATIONS = "(select n_name, n_nationkey, row_number() over (order by n_nationkey) - 1 i from nation)"


def queries() -> dict:
    return {f.__name__: f for f in (vocab_scan, merges_scan, tiktoken_scan, sp_pieces_scan, artifact_discovery, backend_inference)}


def oracle_sql() -> dict:
    return {
        "vocab_scan": f"select n_name as token, i::int as id from {_NATIONS}",
        "merges_scan": f'select substr(n_name, 1, 1) as "left", replace(substr(n_name, 2), \' \', \'_\') as "right", i::int as rank from {_NATIONS}',
        "tiktoken_scan": f"select n_name as token, (i * 2)::int as rank from {_NATIONS}",
        "sp_pieces_scan": f"select i::int as id, n_name as piece, (-i)::float as score, case when i = 0 then 'UNKNOWN' else 'NORMAL' end as type from {_NATIONS}",
        "artifact_discovery": "select * from (values (0, 'tokenizer.json', 'tokenizer.json'), (1, 'piece model', 'a.model'), (2, 'vocab.txt', 'vocab.txt'), (3, 'vocab.json', 'vocab.json'), (4, 'tiktoken', 'x.tiktoken')) t(position, variant, file)",
        "backend_inference": "select * from (values " + ", ".join(f"({i}, '{json.dumps(m, sort_keys=True)}', '{b}')" for i, (m, b) in enumerate(MODELS)) + ") t(n, model, backend)",
    }
