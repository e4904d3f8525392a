"""Queries of the normalizers and pre-tokenizers over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.kernels.alphabet import BYTE_TO_CHAR
from tokenloom.kernels.charsmap import build_charsmap
from tokenloom.operators.segments import segments_relation
from tokenloom.sources.tables import dealt

#: What joins segments in results, a character that texts don't hold.
MARK = "␟"

_WS = r"\s\x0b\x85\p{Z}"
_PUNCT = r"\p{P}$+<=>^`|~"
_RE2_PUNCT = r"\p{P}$+<=>\^`|~"


def text_query(table: str, key: str, column: str, fn):
    """key and the normalized text of each row."""

    def run(spark, sf_dir):
        return dealt(spark, sf_dir, table, key, column).select(key, fn(F.col(column)).alias("value"))

    return run


def segment_query(table: str, key: str, column: str, fn):
    """key, the number of segments, and the segments joined, of each row."""

    def run(spark, sf_dir):
        rows = dealt(spark, sf_dir, table, key, column).select(key, fn(F.col(column)).alias("s"))
        return rows.select(key, F.size("s").cast("long").alias("n"), F.array_join("s", MARK).alias("segments"))

    return run


def text_sql(table: str, key: str, value: str) -> str:
    return f"select {key}, {value} as value from {table}"


def segment_sql(table: str, key: str, segments: str) -> str:
    return f"select {key}, len(s)::bigint as n, coalesce(array_to_string(s, '{MARK}'), '') as segments from (select {key}, {segments} as s from {table})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _extract(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, {quoted(pattern)})"


_TRIM = lambda c: f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace({c}, '[\\x00\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'), '[{_WS}]+', ' ', 'g'), ' ')"
_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in N.CJK)
_PAD = lambda c: f"regexp_replace({c}, '([{_CJK}])', ' \\1 ', 'g')"
_NFD_FREE = lambda c: f"nfc_normalize(strip_accents({c}))"
_NMT = lambda c: f"translate(regexp_replace({c}, '[{''.join(f'\\x{{{x:X}}}' for x in N.NMT_DROPPED)}]', '', 'g'), {'||'.join(f'chr({x})' for x in N.NMT_SPACES)}, {quoted(' ' * len(N.NMT_SPACES))})"
_ALPHABET = "[" + ",".join(quoted(BYTE_TO_CHAR[b]) for b in range(256)) + "]"
_BYTES = lambda c: f"array_to_string(list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda h: {_ALPHABET}[1 + ('0x' || h)::int]), '')"
_GPT2_RE2 = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}\x01]+|[{_WS}]+|\x01"


def gpt2_segments_sql(column: str) -> str:
    """The byte-level split without lookahead: the last white space of a run before other
    text is set apart by a mark, which is then dropped."""
    marked = f"regexp_replace({column}, '([{_WS}])([^{_WS}])', chr(1) || '\\1\\2', 'g')"
    return f"list_filter({_extract(marked, _GPT2_RE2)}, lambda x: x <> chr(1))"


_HAN_RE2 = r"\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}"
_SCRIPTS_RE2 = rf"[{_WS}]*(?:[A-Za-z][A-Za-z{_WS}]*|[{_HAN_RE2}][{_HAN_RE2}{_WS}]*|[^A-Za-z{_HAN_RE2}{_WS}][^A-Za-z{_HAN_RE2}]*)|[{_WS}]+"
_SOLID = "lambda x: length(x) > 0"

DOC = ("documents", "doc_id", "text")
PAGE = ("pages", "page_id", "html")
PART = ("part", "p_partkey", "p_name")
ORDER = ("orders", "o_orderkey", "o_comment")

#: name: (table, function, SQL of the value)
TEXTS = {
    "norm_lowercase": (DOC, N.lowercase, lambda c: f"lower({c})"),
    "norm_nfc": (DOC, N.unicode_form("NFC"), lambda c: f"nfc_normalize({c})"),
    "norm_strip_accents": (DOC, N.strip_accents, _NFD_FREE),
    "norm_strip": (DOC, N.strip(), _TRIM),
    "norm_replace": (DOC, N.replace(r"[0-9]+", "#", regex=True), lambda c: f"regexp_replace({c}, '[0-9]+', '#', 'g')"),
    "norm_prepend": (DOC, N.prepend("▁"), lambda c: f"case when length({c}) > 0 then '▁' || {c} else {c} end"),
    "norm_nmt": (DOC, N.nmt, _NMT),
    "norm_clean_text": (DOC, N.clean_text, _CLEAN),
    "norm_cjk_pad": (DOC, N.pad_cjk, _PAD),
    "norm_bert": (DOC, N.bert(True, True, None, True), lambda c: f"lower({_NFD_FREE(_PAD(_CLEAN(c)))})"),
    "norm_default": (DOC, N.default(True, True, True), lambda c: _PAD(_NFD_FREE(f"lower({c})"))),
    "norm_byte_level": (DOC, N.byte_level, _BYTES),
    "norm_precompiled": (DOC, N.precompiled(build_charsmap({"é": "e", "ß": "ss"})), lambda c: f"replace(replace({c}, 'é', 'e'), 'ß', 'ss')"),
    "norm_sequence": (DOC, N.sequence([N.lowercase, N.strip(), N.replace("the", "THE")]), lambda c: f"replace({_TRIM(f'lower({c})')}, 'the', 'THE')"),
}

#: name: (table, function, SQL of the list)
SEGMENTS = {
    "pretok_whitespace_split": (DOC, P.whitespace_split, lambda c: _extract(c, f"[^{_WS}]+")),
    "pretok_whitespace_gaps": (DOC, P.whitespace_gaps, lambda c: _extract(c, f"[{_WS}]+")),
    "pretok_whitespace_words": (DOC, P.whitespace_words, lambda c: _extract(c, rf"[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}{_WS}]+")),
    "pretok_bert": (DOC, P.bert, lambda c: _extract(c, rf"[{_RE2_PUNCT}]|[^{_WS}{_RE2_PUNCT}]+")),
    "pretok_byte_level": (DOC, P.byte_level(), gpt2_segments_sql),
    "pretok_byte_level_prefix": (DOC, P.byte_level(True), lambda c: gpt2_segments_sql(f"(case when length({c}) = 0 or regexp_matches({c}, '^[{_WS}]') then {c} else ' ' || {c} end)")),
    "pretok_char_delimiter": (PART, P.char_delimiter(" "), lambda c: f"list_filter(string_split({c}, ' '), {_SOLID})"),
    "pretok_digits": (DOC, P.digits(), lambda c: _extract(c, r"\p{N}+|\P{N}+")),
    "pretok_digits_individual": (DOC, P.digits(True), lambda c: _extract(c, r"\p{N}|\P{N}+")),
    "pretok_fixed_length": (DOC, P.fixed_length(5), lambda c: _extract(c, "(?s).{1,5}")),
    "pretok_metaspace": (DOC, P.metaspace(), lambda c: _extract(f"(case when length({c}) = 0 or regexp_matches({c}, '^[{_WS}▁]') then '' else '▁' end || regexp_replace({c}, '[{_WS}]', '▁', 'g'))", "[^▁]*▁|[^▁]+")),
    "pretok_punctuation": (DOC, P.punctuation(), lambda c: _extract(c, r"\p{P}|\P{P}+")),
    "pretok_split_removed": (PAGE, P.split("[<>]", "removed"), lambda c: f"list_filter(regexp_split_to_array({c}, '[<>]'), {_SOLID})"),
    "pretok_split_isolated": (PAGE, P.split("[<>]", "isolated"), lambda c: _extract(c, "[<>]|[^<>]+")),
    "pretok_split_merged_prev": (PAGE, P.split("[<>]", "merged_with_previous"), lambda c: _extract(c, "[^<>]*[<>]|[^<>]+")),
    "pretok_split_merged_next": (PAGE, P.split("[<>]", "merged_with_next"), lambda c: f"case when regexp_matches({c}, '[<>]') then list_concat([regexp_extract({c}, '^[^<>]*[<>][^<>]*')], {_extract(f'substr({c}, 1 + length(regexp_extract({c}, {quoted('^[^<>]*[<>][^<>]*')})))', '[<>][^<>]*')}) else [] end"),
    "pretok_split_contiguous": (PAGE, P.split("[<>/]", "contiguous"), lambda c: _extract(c, "[<>/]+|[^<>/]+")),
    "pretok_split_inverted": (PAGE, P.split("[<>]", "isolated", invert=True), lambda c: f"list_filter(regexp_split_to_array({c}, '[<>]'), {_SOLID})"),
    "pretok_unicode_scripts": (DOC, P.unicode_scripts, lambda c: _extract(c, _SCRIPTS_RE2)),
    "pretok_sequence": (DOC, P.sequence([P.whitespace_split, P.punctuation(), P.digits()]), lambda c: f"flatten(list_transform(flatten(list_transform({_extract(c, f'[^{_WS}]+')}, lambda x: {_extract('x', r'\p{P}|\P{P}+')})), lambda y: {_extract('y', r'\p{N}+|\P{N}+')}))"),
}


#: name: (function, pattern of tiles that segments are among, pattern of tiles that are none, unit)
PLACES = {
    "segments_bert": (P.bert, rf"[{_WS}]+|[{_RE2_PUNCT}]|[^{_WS}{_RE2_PUNCT}]+", f"^[{_WS}]+$", "characters"),
    "segments_whitespace": (P.whitespace_split, f"[{_WS}]+|[^{_WS}]+", f"^[{_WS}]+$", "characters"),
    "segments_digits": (P.digits(), r"\p{N}+|\P{N}+", "^$", "characters"),
    "segments_fixed_length_bytes": (P.fixed_length(5), "(?s).{1,5}", "^$", "bytes"),
}


def place_query(fn, unit: str):
    """doc_id, pos, segment, start, end of every segment."""

    def run(spark, sf_dir):
        return segments_relation(dealt(spark, sf_dir, "documents", "doc_id", "text"), fn, keys=["doc_id"], unit=unit)

    return run


def place_sql(tiles: str, gap: str, unit: str) -> str:
    size = "strlen(w)" if unit == "bytes" else "length(w)"
    return f"""with tiles as (select doc_id, unnest(s) w, generate_subscripts(s, 1) t from (select doc_id, {_extract('text', tiles)} s from documents)),
placed as (select doc_id, w, t, sum({size}) over (partition by doc_id order by t) e from tiles)
select doc_id, (row_number() over (partition by doc_id order by t) - 1)::int pos, w segment, (e - {size})::int "start", e::int "end" from placed where not regexp_matches(w, {quoted(gap)})"""


#: Forms that SQL lacks; they are compared with Python's in the tests.
FORMS = {f"norm_{form.lower()}": text_query(*DOC, N.unicode_form(form)) for form in ("NFD", "NFKC", "NFKD")}


def queries() -> dict:
    return FORMS | {name: place_query(fn, unit) for name, (fn, _, _, unit) in PLACES.items()} | {name: text_query(*table, fn) for name, (table, fn, _) in TEXTS.items()} | {name: segment_query(*table, fn) for name, (table, fn, _) in SEGMENTS.items()}


def oracle_sql() -> dict:
    return {name: place_sql(tiles, gap, unit) for name, (_, tiles, gap, unit) in PLACES.items()} | {name: text_sql(*table[:2], sql(table[2])) for name, (table, _, sql) in TEXTS.items()} | {name: segment_sql(*table[:2], sql(table[2])) for name, (table, _, sql) in SEGMENTS.items()}
