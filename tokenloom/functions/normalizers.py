"""Normalizers: string columns to string columns. All but the Unicode forms, accents and
precompiled maps are plain expressions that stay in the JVM. Null stays null, empty empty."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.kernels.alphabet import BYTE_TO_CHAR
from tokenloom.kernels.charsmap import CharsMap, shared_charsmap

Normalizer = Callable[[Column], Column]

#: White space as the engine understands it everywhere.
SPACE_CLASS = r"\f\n\r\t\x0B\x85\p{Z}"
#: CJK blocks that get spaces around them (fixed values).
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
#: Characters that the translation normalizer drops, and those it makes spaces (fixed values).
NMT_DROPPED = [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]
NMT_SPACES = [0x09, 0x0A, 0x0C, 0x0D, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]


def lowercase(c: Column) -> Column:
    return F.lower(c)


def unicode_form(form: str) -> Normalizer:
    """NFC, NFD, NFKC or NFKD."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown Unicode form {form}")

    def run(c: Column) -> Column:
        @F.pandas_udf("string")
        def apply(s: pd.Series) -> pd.Series:
            return s.map(lambda t: t if t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

        return apply(c)

    return run


def without_accents(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn"))


def strip_accents(c: Column) -> Column:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(without_accents, na_action="ignore")

    return apply(c)


def strip(left: bool = True, right: bool = True) -> Normalizer:
    ends = [p for p, on in ((rf"^[{SPACE_CLASS}]+", left), (rf"[{SPACE_CLASS}]+\z", right)) if on]
    return lambda c: F.regexp_replace(c, "|".join(ends), "") if ends else c


def replace(pattern: str | None, content: str = "", regex: bool = False) -> Normalizer:
    """Without a pattern, as when built from JSON, the identity."""
    if not pattern:
        return lambda c: c
    if regex:
        return lambda c: F.regexp_replace(c, pattern, content)
    return lambda c: F.replace(c, F.lit(pattern), F.lit(content))


def prepend(prefix: str | None) -> Normalizer:
    return lambda c: F.when(F.length(c) > 0, F.concat(F.lit(prefix), c)).otherwise(c) if prefix else c


def nmt(c: Column) -> Column:
    spaces = "".join(map(chr, NMT_SPACES))
    return F.translate(c, spaces + "".join(map(chr, NMT_DROPPED)), " " * len(spaces))


def clean_text(c: Column) -> Column:
    """Drops controls (also tabs and line ends), then makes white space single spaces and trims."""
    kept = F.regexp_replace(c, r"[\x00\x{FFFD}\p{Cn}\p{Cc}\p{Cf}\p{Co}]", "")
    return F.trim(F.regexp_replace(kept, rf"[{SPACE_CLASS}]+", " "))


def pad_cjk(c: Column) -> Column:
    blocks = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK)
    return F.regexp_replace(c, f"([{blocks}])", " $1 ")


def bert(clean: bool = False, cjk: bool = False, accents: bool | None = None, lower: bool = False) -> Normalizer:
    """In order: cleaning, CJK padding, accents off (by default with lower-casing), lower case."""

    def apply(c: Column) -> Column:
        c = clean_text(c) if clean else c
        c = pad_cjk(c) if cjk else c
        c = strip_accents(c) if accents or accents is None and lower else c
        return lowercase(c) if lower else c

    return apply


def default(lower: bool = False, accents: bool = False, cjk: bool = False) -> Normalizer:
    """What stands for an unknown type: lower case, accents off, CJK padding, as flagged."""

    def apply(c: Column) -> Column:
        c = lowercase(c) if lower else c
        c = strip_accents(c) if accents else c
        return pad_cjk(c) if cjk else c

    return apply


def byte_level(c: Column) -> Column:
    """UTF-8 bytes as printable characters: each byte is a Latin-1 character, then renamed."""
    moved = {b: ch for b, ch in BYTE_TO_CHAR.items() if chr(b) != ch}
    return F.translate(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), "".join(map(chr, moved)), "".join(moved.values()))


def precompiled(charsmap: bytes | None) -> Normalizer:
    """The longest replacements of a precompiled character map; without one the identity."""
    if not charsmap:
        return lambda c: c
    CharsMap(charsmap)  # refuses malformed maps when the plan is built

    def run(c: Column) -> Column:
        @F.pandas_udf("string")
        def apply(s: pd.Series) -> pd.Series:
            return s.map(shared_charsmap(charsmap).normalize, na_action="ignore")

        return apply(c)

    return run


def sequence(parts: Sequence[Normalizer]) -> Normalizer:
    def apply(c: Column) -> Column:
        for part in parts:
            c = part(c)
        return c

    return apply


def from_config(config: dict | None) -> Normalizer | None:
    """A normalizer from its JSON: types ignore case; pattern, content, prefix and sides are
    not read from JSON, so Replace and Prepend are the identity there and Strip is two-sided."""
    if callable(config):  # a component of the user's own
        return config
    if not config:
        return None
    kind = re.sub("normalizer$", "", str(config.get("type", "")).lower())
    flag = lambda k: bool(config.get(k))
    if kind in ("nfc", "nfd", "nfkc", "nfkd"):
        return unicode_form(kind.upper())
    if kind == "sequence":
        return sequence([p for p in map(from_config, config.get("normalizers") or []) if p])
    if kind == "bert":
        return bert(flag("clean_text"), flag("handle_chinese_chars"), config.get("strip_accents"), flag("lowercase"))
    if kind == "precompiled":
        import base64

        raw = config.get("precompiled_charsmap")
        return precompiled(base64.b64decode(raw) if raw else None)
    plain = {"lowercase": lowercase, "stripaccents": strip_accents, "strip": strip(), "replace": replace(None), "prepend": prepend(None), "nmt": nmt, "bytelevel": byte_level}
    return plain.get(kind) or default(flag("lowercase"), flag("strip_accents"), flag("handle_chinese_chars"))
