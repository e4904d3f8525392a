"""Decoders: arrays of tokens to text, as expressions; only bytes that may be no valid UTF-8
go through an Arrow function. Null stays null."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.normalizers import SPACE_CLASS
from tokenloom.kernels.batches import flattened
from tokenloom.kernels.bpe import from_alphabet

Decoder = Callable[[Column], Column]

_TAILS = "t|re|ve|ll|d|s|m"


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def default(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def wordpiece(prefix: str = "##", cleanup: bool = True) -> Decoder:
    """Tokens joined by spaces, those with the prefix glued on."""

    def apply(tokens: Column) -> Column:
        glued = F.transform(tokens, lambda t, i: F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t))).when(i == 0, t).otherwise(F.concat(F.lit(" "), t)))
        text = F.array_join(glued, "")
        return wordpiece_cleanup(text) if cleanup else text

    return apply


def wordpiece_cleanup(text: Column) -> Column:
    """No white space before signs and English endings, single spaces elsewhere, none at the ends."""
    text = F.regexp_replace(text, rf"[{SPACE_CLASS}]+([.!?,])", "$1")
    text = F.regexp_replace(text, rf"(?i)[{SPACE_CLASS}]+'[{SPACE_CLASS}]*({_TAILS})(?![\p{{L}}\p{{N}}_])", "'$1")
    return F.regexp_replace(F.regexp_replace(text, rf"[{SPACE_CLASS}]+", " "), r"^ | \z", "")


def bpe(suffix: str = "</w>") -> Decoder:
    """The suffix as a space, at the last token as nothing; no white space at the end."""

    def apply(tokens: Column) -> Column:
        if not suffix:
            return default(tokens)
        # no lambda refers to the whole array: it would be made anew for each of its elements
        spell = lambda part, by: F.transform(part, lambda t: F.replace(t, F.lit(suffix), F.lit(by)))
        n = F.size(tokens)
        parts = F.concat(spell(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), " "), spell(F.slice(tokens, F.greatest(n, F.lit(1)), F.lit(1)), ""))
        return F.regexp_replace(F.array_join(parts, ""), rf"[{SPACE_CLASS}]+\z", "")

    return apply


def byte_level(tokens: Column) -> Column:
    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else from_alphabet(t) for t in texts.to_pylist()), pa.string())

    return apply(default(tokens))


def fall_back(tokens: list[str]) -> str:
    """Runs of <0xHH> as UTF-8, other tokens as they are."""
    out, run = [], b""
    for t in [*tokens, None]:
        m = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", t) if t is not None else None
        if m:
            run += bytes([int(m[1], 16)])
            continue
        out.append(run.decode(errors="replace"))
        run = b""
        out.append(t or "")
    return "".join(out)


def fall_back_column(column: pa.Array) -> pa.Array:
    """``fall_back`` of all rows: each distinct token is looked at once. Bytes may be joined with the
    texts beside them, which never go on with a character; only empty tokens part two runs."""
    first, flat, lost = flattened(column, column)
    distinct = flat.dictionary_encode()
    known = distinct.dictionary.to_pylist()
    spelled = pa.array([bytes([int(t[3:5], 16)]) if _BYTE.fullmatch(t) else t.encode() for t in known], pa.binary())
    made = pa.ListArray.from_arrays(pa.array(first, pa.int32()), spelled.take(distinct.indices), mask=pa.array(lost))
    texts = [None if b is None else b.decode(errors="replace") for b in pc.binary_join(made, b"").to_pylist()]
    parted = np.concatenate([[0], np.cumsum(pc.fill_null(pc.equal(pc.binary_length(flat), 0), True).to_numpy(zero_copy_only=False))])
    for d in np.flatnonzero((parted[first[1:]] > parted[first[:-1]]) & ~lost).tolist():
        texts[d] = fall_back(column[d].as_py())
    return pa.array(texts, pa.string())


_BYTE = re.compile("<0x([0-9A-Fa-f]{2})>")


def byte_fallback(tokens: Column) -> Column:
    return F.arrow_udf(fall_back_column, "string")(tokens)


def ctc(pad: str = "<pad>", delimiter: str = "|", cleanup: bool = True) -> Decoder:
    """Drops padding and repeats, also repeats across padding."""

    def apply(tokens: Column) -> Column:
        kept = F.filter(tokens, lambda t: t != pad)
        before = F.concat(F.array(F.lit(None).cast("string")), kept)
        once = F.array_compact(F.zip_with(kept, before, lambda t, b: F.when(~t.eqNullSafe(b), t)))
        text = F.replace(F.array_join(once, ""), F.lit(delimiter), F.lit(" ")) if delimiter else F.array_join(once, "")
        if not cleanup:
            return text
        text = F.regexp_replace(text, rf"[{SPACE_CLASS}]+([.!?,:;])", "$1")
        return F.regexp_replace(text, rf"(?i)[{SPACE_CLASS}]+('(?:{_TAILS}))(?![\p{{L}}\p{{N}}_])", "$1")

    return apply


def metaspace(replacement: str = "▁", prepend: str = "always") -> Decoder:
    def apply(tokens: Column) -> Column:
        text = F.replace(default(tokens), F.lit(replacement), F.lit(" ")) if replacement else default(tokens)
        return F.regexp_replace(text, "^ ", "") if prepend == "always" else text

    return apply


def sequence(parts: Sequence[Decoder]) -> Decoder:
    """Tokens are joined first; each part then gets that one text as its only token."""

    def apply(tokens: Column) -> Column:
        text = default(tokens)
        for part in parts:
            text = part(F.array(text))
        return text

    return apply


def from_config(config: dict | None) -> Decoder:
    """A decoder from its JSON; missing strings count as empty there."""
    if callable(config):  # a component of the user's own
        return config
    if not config:
        return default
    kind = str(config.get("type", "")).lower().removesuffix("decoder")
    text = lambda k: config.get(k) or ""
    made = {
        "wordpiece": lambda: wordpiece(text("prefix"), config.get("cleanup", True) is not False),
        "bpe": lambda: bpe(text("suffix")),
        "bytelevel": lambda: byte_level,
        "bytefallback": lambda: byte_fallback,
        "ctc": lambda: ctc(text("pad_token"), text("word_delimiter_token"), config.get("cleanup", True) is not False),
        "metaspace": lambda: metaspace(text("replacement"), text("prepend_scheme")),
        "sequence": lambda: sequence([from_config(d) for d in config.get("decoders") or []]),
    }
    return made.get(kind, lambda: default)()
