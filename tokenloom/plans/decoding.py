"""Queries of the decoders, over tokens made from the documents and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import decoders as D
from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.plans.text import _RE2_PUNCT, _WS, _extract
from tokenloom.sources.tables import dealt

_TAIL = "(t|re|ve|ll|d|s|m)"


def _over(table: str, key: str, column: str, fn):
    def run(spark, sf_dir):
        return dealt(spark, sf_dir, table, key, column).select(key, fn(F.col(column)).alias("value"))

    return run


def _characters(c):
    return F.filter(F.split(c, ""), lambda x: F.length(x) > 0)


def _ctc_tokens(c):
    """Characters, spaces as delimiters, padding before every fourth."""
    return F.flatten(F.transform(_characters(c), lambda x, i: F.when(i % 4 == 0, F.array(F.lit("<pad>"), F.when(x == " ", F.lit("|")).otherwise(x))).otherwise(F.array(F.when(x == " ", F.lit("|")).otherwise(x)))))


def _suffixed(c):
    return F.transform(P.whitespace_split(c), lambda w: F.concat(w, F.lit("</w>")))


def _hex_tokens(c):
    return F.split(F.rtrim(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "<0x$1> ")), " ")


def _halves(c):
    """Bert segments, words of over four characters in two pieces."""
    return F.flatten(F.transform(P.bert(c), lambda w: F.when(F.length(w) > 4, F.array(F.substring(w, 1, 3), F.concat(F.lit("##"), F.substring(w, F.lit(4), F.length(w))))).otherwise(F.array(w))))


_BERT = lambda c: _extract(c, rf"[{_RE2_PUNCT}]|[^{_WS}{_RE2_PUNCT}]+")


def _cleaned(x: str) -> str:
    step = f"regexp_replace({x}, '[{_WS}]+([.!?,])', '\\1', 'g')"
    step = f"regexp_replace({step}, '(?i)[{_WS}]+''[{_WS}]*{_TAIL}($|[^\\p{{L}}\\p{{N}}_])', '''\\1\\2', 'g')"
    return f"trim(regexp_replace({step}, '[{_WS}]+', ' ', 'g'), ' ')"


_META = f"(case when length(text) = 0 or regexp_matches(text, '^[{_WS}▁]') then '' else '▁' end || regexp_replace(text, '[{_WS}]', '▁', 'g'))"
_CTC = """with t as (select p_partkey, list_filter(string_split(p_name, ''), lambda x: x <> '') c from part)
select p_partkey, replace(coalesce(array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: case when i = 1 or c[i] <> c[i - 1] then c[i] end), lambda x: x is not null), ''), ''), '|', ' ') as value from t"""

QUERIES = {
    "decode_wordpiece": _over("documents", "doc_id", "text", lambda c: D.wordpiece()(_halves(c))),
    "decode_bpe_suffix": _over("documents", "doc_id", "text", lambda c: D.bpe("</w>")(_suffixed(c))),
    "decode_byte_level": _over("documents", "doc_id", "text", lambda c: D.byte_level(P.byte_level()(N.byte_level(c)))),
    "decode_byte_fallback": _over("documents", "doc_id", "text", lambda c: D.byte_fallback(_hex_tokens(c))),
    "decode_ctc": _over("part", "p_partkey", "p_name", lambda c: D.ctc(cleanup=False)(_ctc_tokens(c))),
    "decode_metaspace": _over("documents", "doc_id", "text", lambda c: D.metaspace()(P.metaspace()(c))),
    "decode_sequence": _over("documents", "doc_id", "text", lambda c: D.sequence([D.metaspace("▁", "never"), D.bpe("</w>")])(_suffixed(c))),
    "decode_default": _over("documents", "doc_id", "text", lambda c: D.default(P.whitespace_split(c))),
}

SQL = {
    "decode_wordpiece": f"select doc_id, {_cleaned(f'''array_to_string({_BERT('text')}, ' ')''')} as value from documents",
    "decode_bpe_suffix": f"select doc_id, coalesce(array_to_string({_extract('text', f'[^{_WS}]+')}, ' '), '') as value from documents",
    "decode_byte_level": "select doc_id, text as value from documents",
    "decode_byte_fallback": "select doc_id, text as value from documents",
    "decode_ctc": _CTC,
    "decode_metaspace": f"select doc_id, regexp_replace(replace({_META}, '▁', ' '), '^ ', '') as value from documents",
    "decode_sequence": f"select doc_id, coalesce(array_to_string({_extract('text', f'[^{_WS}]+')}, ''), '') as value from documents",
    "decode_default": f"select doc_id, coalesce(array_to_string({_extract('text', f'[^{_WS}]+')}, ''), '') as value from documents",
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
