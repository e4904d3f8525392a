"""Pre-tokenizers: string columns to arrays of segments, as expressions that stay in the JVM.
Offsets follow from the segments' places in the text (see operators.relations)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.normalizers import SPACE_CLASS

PreTokenizer = Callable[[Column], Column]

#: ASCII signs that count as punctuation beside the Unicode categories (fixed values).
ASCII_SIGNS = r"$+<=>^`|~"
PUNCTUATION = r"\p{P}" + re.escape(ASCII_SIGNS)
#: The byte-level split pattern (a fixed value of the format).
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Japanese kana and the ideographs that count as one script with them.
HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}"


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def _upto(pattern: str) -> str:
    """A character from which on the pattern doesn't match. Repetitions of it have to be
    possessive: then the JVM runs them in a loop, while others recurse once a character."""
    return f"(?:(?!{pattern}).)"


def whitespace_split(c: Column) -> Column:
    return matches(c, rf"[^{SPACE_CLASS}]+")


def whitespace_gaps(c: Column) -> Column:
    """The runs of white space between words and signs, as the type named Whitespace gives."""
    return matches(c, rf"[{SPACE_CLASS}]+")


def whitespace_words(c: Column) -> Column:
    """Words and runs of signs: what Whitespace is commonly taken to give."""
    word = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
    return matches(c, rf"[{word}]+|[^{word}{SPACE_CLASS}]+")


def bert(c: Column) -> Column:
    return matches(c, rf"[{PUNCTUATION}]|[^{SPACE_CLASS}{PUNCTUATION}]+")


def byte_level(add_prefix_space: bool = False, use_regex: bool = True) -> PreTokenizer:
    def apply(c: Column) -> Column:
        if add_prefix_space:
            c = F.when(F.length(c) == 0, c).when(c.rlike(rf"\A[{SPACE_CLASS}]"), c).otherwise(F.concat(F.lit(" "), c))
        return matches(c, "(?U)" + GPT2) if use_regex else F.filter(F.array(c), lambda x: F.length(x) > 0)

    return apply


def char_delimiter(delimiter: str) -> PreTokenizer:
    if not delimiter:
        return whitespace_split
    return lambda c: F.filter(F.split(c, re.escape(delimiter), -1), lambda x: F.length(x) > 0)


def digits(individual: bool = False) -> PreTokenizer:
    return lambda c: matches(c, r"\p{N}|\P{N}+" if individual else r"\p{N}+|\P{N}+")


def fixed_length(length: int = 5) -> PreTokenizer:
    return lambda c: matches(c, f"(?s).{{1,{length}}}")


def metaspace(replacement: str = "▁", prepend: str = "always") -> PreTokenizer:
    """Replaced white space stays at the end of the part before it."""

    def apply(c: Column) -> Column:
        made = F.regexp_replace(c, rf"[{SPACE_CLASS}]", replacement.replace("\\", "\\\\").replace("$", "\\$"))
        if not replacement:
            return F.filter(F.array(made), lambda x: F.length(x) > 0)
        if prepend in ("always", "first"):
            made = F.when((F.length(made) == 0) | F.startswith(made, F.lit(replacement)), made).otherwise(F.concat(F.lit(replacement), made))
        mark = re.escape(replacement)
        return matches(made, rf"(?s){_upto(mark)}*+{mark}|{_upto(mark)}++")

    return apply


def punctuation(behavior: str = "isolated") -> PreTokenizer:
    return split(r"\p{P}", behavior)


def split(pattern: str, behavior: str = "isolated", invert: bool = False) -> PreTokenizer:
    """Behaviours: removed, isolated, merged_with_previous, merged_with_next, contiguous;
    anything else isolates. The pattern needs to match one character at least. Inverted,
    the text between matches is given whatever the behaviour."""
    p = f"(?:{pattern})"
    if invert or behavior == "removed":
        return lambda c: F.filter(F.split(c, p, -1), lambda x: F.length(x) > 0)
    if behavior == "merged_with_previous":
        return lambda c: matches(c, rf"(?s){_upto(p)}*+{p}|{_upto(p)}++")
    if behavior == "merged_with_next":
        # what stands before the first match stays with it; without a match there is nothing
        return lambda c: F.when(c.rlike(p), matches(c, rf"(?s)\A{_upto(p)}*+{p}{_upto(p)}*+|{p}{_upto(p)}*+")).otherwise(F.array().cast("array<string>"))
    if behavior == "contiguous":
        return lambda c: matches(c, rf"(?s){p}++|{_upto(p)}++")
    return lambda c: matches(c, rf"(?s){p}|{_upto(p)}++")


def unicode_scripts(c: Column) -> Column:
    """Cuts where the script changes among Latin (ASCII letters), Han and kana, and all else;
    white space belongs to what it stands with."""
    ws, other = SPACE_CLASS, rf"A-Za-z{HAN}"
    runs = rf"[A-Za-z][A-Za-z{ws}]*|[{HAN}][{HAN}{ws}]*|[^{other}{ws}][^{other}]*"
    return matches(c, rf"[{ws}]*(?:{runs})|[{ws}]+")


def sequence(parts: Sequence[PreTokenizer]) -> PreTokenizer:
    """Each part cuts the segments of those before it."""

    def apply(c: Column) -> Column:
        out = F.filter(F.array(c), lambda x: F.length(x) > 0)
        for part in parts:
            out = F.flatten(F.transform(out, part))
        return out

    return apply


def from_config(config: dict | None) -> PreTokenizer | None:
    """A pre-tokenizer from its JSON: types ignore case, a behaviour written in camel case
    isn't recognised and isolates, missing strings count as empty, unknown types split at
    white space."""
    if callable(config):  # a component of the user's own
        return config
    if not config:
        return None
    kind = re.sub("pretokenizer$", "", str(config.get("type", "")).lower())
    if kind == "sequence":
        return sequence([p for p in map(from_config, config.get("pretokenizers") or []) if p])
    if kind == "split":
        pattern = config.get("pattern") or ""
        if isinstance(pattern, dict):
            pattern = pattern.get("Regex") or pattern.get("String") or ""
        wrapped = re.fullmatch(r'Regex\("(.*)"\)', pattern, re.S)
        pattern = wrapped[1] if wrapped else pattern
        return split(pattern, str(config.get("behavior") or "").lower(), bool(config.get("invert"))) if pattern else whitespace_split
    made = {
        "whitespacesplit": lambda: whitespace_split,
        "whitespace": lambda: whitespace_gaps,
        "bert": lambda: bert,
        "bytelevel": lambda: byte_level(bool(config.get("add_prefix_space")), config.get("use_regex") is not False),
        "chardelimitersplit": lambda: char_delimiter(config.get("delimiter") or ""),
        "digits": lambda: digits(bool(config.get("individual_digits"))),
        "fixedlength": lambda: fixed_length(int(config.get("length") or 5)),
        "metaspace": lambda: metaspace(config.get("replacement") or "", config.get("prepend_scheme") or ""),
        "punctuation": lambda: punctuation(str(config.get("behavior") or "").lower()),
        "unicodescripts": lambda: unicode_scripts,
    }
    return made.get(kind, lambda: whitespace_split)()
