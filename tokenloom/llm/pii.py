"""Operator 7, surrogates for personal data.

Detected entities are replaced by made-up ones of the same type and shape. The replacement is
a keyed permutation of all values of that shape (a Feistel network over the mixed-radix number
that the varying characters spell, walked until it falls inside), moved on by one step inside
the permutation, so that no value stays itself. A permutation can't bring two values to one,
and it needs no memory: distinct entities stay distinct and equal ones equal, in all documents
and on all machines. Separators, case, script, country and area layout, card check digits,
IBAN checks and domains' last parts keep their form. Listed given names are permuted among
those of their gender; other names letter by letter among the vowels or consonants of their
script, the ending kept, since endings mark gender. Every maker brings values that differ by
more than case to surrogates that do so too, invalid numbers and odd spellings included: what
would look like a value of another class (a hexadecimal secret, a listed name, a valid check)
is passed over on the walk. So an entity has one surrogate, whatever text it stands in.

Names are found behind titles in any case (in lower case themselves only behind those titles
that mean nothing else), where a listed given name has a surname behind it, and where a part
of a found name is mentioned again. Entities may have any length.

Defined results: a null text stays null and has no entities; an empty one stays empty; texts
without entities are unchanged; equal rows are changed equally; a null n_chars stays null;
an empty table gives an empty result; ``replace`` keeps all other columns."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.kernels.pieces import lower_each
from tokenloom.llm.common import map_batches, slices

#: The default key; a deployment gives its own secret.
KEY = "tokenloom-surrogates"

#: Alphabets whose letters are exchanged among themselves (fixed values).
ALPHABETS = ["0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "áàâäéèêëíìîïóòôöúùûü", "çñß", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_GROUP = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
_GROUP["ς"] = _GROUP["σ"]
HEX = "0123456789abcdef"

#: Given names by gender and script (fixed values).
NAMES = {
    "m": "james john robert michael david william richard thomas charles daniel matthew anthony mark paul steven andrew kenneth george peter henry hans karl fritz jean pierre louis carlos juan jose luis miguel pablo".split(),
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley emily anna emma laura heidi ingrid marie claire sophie carmen maria lucia elena sofia isabel ana".split(),
    "m-cyrillic": "иван пётр сергей андрей дмитрий николай михаил алексей".split(),
    "f-cyrillic": "анна мария елена ольга татьяна наталья ирина светлана".split(),
}
_NAME_LIST = {n: names for names in NAMES.values() for n in names}
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme|г-н|г-жа"
#: Titles that stand for nothing else, so that a name behind them may be in lower case, and
#: words of lower case that are no names (fixed values).
SURE_TITLES = frozenset(["mr", "mrs", "dr", "prof"])
NO_NAMES = frozenset("and the for with who was has had his her our your not are but from said says will can der die das und les des que est los las".split())

#: Types and their patterns, the more specific first; group v is replaced, else the whole.
PATTERNS = [
    ("secret", r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?)(?P<v>[A-Za-z0-9_\-+/.]{8,}(?:={1,2})?)"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})\b"),
    ("email", r"(?<![\w.+%-])[\w+%-](?:[\w.+%-]*[\w+%-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    ("card", r"(?<![\d.,-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?i:\b(?:call|phone|tel|telephone|fax|mobile|cell|telefon|handy|tél|teléfono)\b[.:]{0,2} ?)(?P<v>\+?\(?\d(?:[ ()./-]{0,2}\d){6,14})(?![\d-])"),
    ("phone", r"(?<![\w.+/-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\d.,/-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("name", rf"\b(?P<t>(?i:{TITLES}))\.? (?=(?P<v>[^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_]+(?:-[^\W\d_]+)?){{0,2}}))"),
    ("name", rf"\b(?P<v>(?:{'|'.join(sorted({n for names in NAMES.values() for w in names for n in (w.capitalize(), w.upper())}))})(?: (?:[^\W\d_]\. )?[^\W\d_]+(?:-[^\W\d_]+)?){{1,2}})"),
]
_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
#: Runs that may be a secret without a word before them.
_LIKELY = re.compile(r"[0-9A-Fa-f]{32}")
_DIGIT = re.compile(r"\d")


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, len(w))
    out.make_automaton()
    return out


#: What a text has to hold for a kind of entity to be looked for: beginnings of keys and
#: secrets in lower case, titles in lower case, given names with what follows.
_SECRETS = _automaton(["token", "secret", "key", "passw", "pwd", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"])
_TITLES = _automaton([t.lower() + end for t in TITLES.split("|") for end in (" ", ". ")])
_GIVEN = _automaton([n + " " for names in NAMES.values() for w in names for n in (w.capitalize(), w.upper())])


def _stands(found: ahocorasick.Automaton, text: str) -> bool:
    """Whether one of these words begins somewhere in the text."""
    return any(end + 1 == size or not (text[end - size].isalnum() or text[end - size] == "_") for end, size in found.iter(text))


def _sought(text: str) -> set[str]:
    """The kinds of entities that the text may hold."""
    low = text.lower()
    out = {"name"} if _stands(_TITLES, low) or _stands(_GIVEN, text) else set()
    if next(_SECRETS.iter(low), None) or _LIKELY.search(text):
        out.add("secret")
    if "@" in text:
        out.add("email")
    if _DIGIT.search(text):
        out |= {"iban", "ip", "card", "ssn", "phone"}
    return out


def _feistel(value: int, size: int, key: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, or its inverse."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, width = (1 << half) - 1, half // 8 + 1
    secret = hashlib.sha256(f"{key}:{size}".encode()).digest()
    while True:
        left, right = value >> half, value & mask
        for r in range(7, -1, -1) if back else range(8):
            side = left if back else right
            digest = hashlib.blake2b(bytes([r]) + side.to_bytes(width, "big"), key=secret, digest_size=64).digest()
            mixed = int.from_bytes(digest * (half // 512 + 1), "big") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def permute(value: int, size: int, key: str) -> int:
    """A keyed permutation of 0 .. size - 1 that leaves no value where it was (for size > 1)."""
    return _feistel((_feistel(value, size, key) + 1) % size, size, key, back=True)


def permute_long(digits: np.ndarray, bases: np.ndarray, key: str) -> np.ndarray:
    """As ``permute``, for a number given by its digits and their bases, in linear time: every
    second digit is moved on by what a keyed hash makes of all others, in turns."""
    sides = [slice(0, None, 2), slice(1, None, 2)]

    def turn(x: np.ndarray, r: int, sign: int) -> None:
        to, by = sides[r % 2], sides[1 - r % 2]
        stream = hashlib.shake_256(f"{key}:{r}:".encode() + x[by].astype(np.uint8).tobytes()).digest(8 * len(x[to]))
        x[to] = (x[to] + sign * (np.frombuffer(stream, "<u8") % bases[to].astype(np.uint64)).astype(np.int64)) % bases[to]

    x = digits.astype(np.int64).copy()
    for r in range(8):
        turn(x, r, 1)
    low = len(x) - 1  # the next number: trailing digits that are full turn over
    while low > 0 and x[low] == bases[low] - 1:
        x[low] = 0
        low -= 1
    x[low] = (x[low] + 1) % bases[low]
    for r in range(7, -1, -1):
        turn(x, r, -1)
    return x


#: Varying characters beyond which they are permuted digit by digit, not as one number.
LONG = 128


def respell(text: str, key: str, groups=_GROUP.get) -> str:
    """Exchanges the letters and digits of ``text`` within their alphabets, as one number."""
    spots = [(i, *groups(c.lower())) for i, c in enumerate(text) if groups(c.lower())]
    if not spots:
        return text
    shape = hashlib.sha256("".join(a[0] for _, a, _ in spots).encode()).hexdigest()
    if len(spots) > LONG:
        made = permute_long(np.array([d for _, _, d in spots]), np.array([len(a) for _, a, _ in spots]), f"{key}:{shape}").tolist()
    else:
        value, size, made = 0, 1, []
        for _, alphabet, digit in spots:
            value, size = value * len(alphabet) + digit, size * len(alphabet)
        value = permute(value, size, f"{key}:{shape}")
        for _, alphabet, _ in reversed(spots):
            value, digit = divmod(value, len(alphabet))
            made.insert(0, digit)
    out = list(text)
    for (i, alphabet, _), digit in zip(spots, made, strict=True):
        out[i] = _upper(alphabet[digit]) if text[i].isupper() else alphabet[digit]
    return "".join(out)


def _upper(c: str) -> str:
    return "ẞ" if c == "ß" else c.upper()


def fold(text: str) -> str:
    """Lower case, one character for each."""
    return lower_each(text).replace("ς", "σ")


def luhn(digits: str) -> int:
    """The check digit behind these digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _into(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _card(text: str, key: str) -> str:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) == int(digits[-1]):
        body = respell(digits[:-1], key + ":luhn")
        return _into(text, body + str(luhn(body)))
    size = 10 ** (len(digits) - 1) * 9  # numbers that fail the check, so that none turns into a valid one
    body, last = digits[:-1], int(digits[-1])
    rank = int(body) * 9 + (last - (last > luhn(body)))
    rank = permute(rank, size, key)
    body = str(rank // 9).zfill(len(digits) - 1)
    check, last = luhn(body), rank % 9
    return _into(text, body + str(last + (last >= check)))


def _ip(text: str, key: str) -> str:
    parts = text.split(".")
    if all(p == str(int(p)) for p in parts):
        value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key)
        return ".".join(map(str, value.to_bytes(4, "big")))
    # with leading zeros: among the addresses of the same widths that have one too
    sizes = [(10, 100, 256)[len(p) - 1] for p in parts]
    size, value = 1, 0
    for p, n in zip(parts, sizes, strict=True):
        value, size = value * n + int(p), size * n
    made = parts
    while made is parts or all(p == str(int(p)) for p in made):
        value, made = permute(value, size, f"{key}:{sizes}"), []
        rest = value
        for p, n in zip(parts[::-1], sizes[::-1], strict=True):
            rest, x = divmod(rest, n)
            made.insert(0, str(x).zfill(len(p)))
    return ".".join(made)


def _iban(text: str, key: str) -> str:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], int(plain[2:4]), plain[4:]
    if check == (good := _iban_check(country, body)):
        body = respell(body, key)
        check = _iban_check(country, body)
    else:  # numbers that fail the check, so that none turns into a valid one
        rank = permute(check - (check > good), 99, f"{key}:bad:{body}")
        body = respell(body, key + ":bad")
        check = rank + (rank >= _iban_check(country, body))
    made = iter(f"{country}{check:02d}{body}")
    return "".join(c if c == " " else next(made) for c in text)


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _email(text: str, key: str) -> str:
    local, _, domain = text.rpartition("@")
    head, _, tail = domain.rpartition(".")
    return f"{respell(f'{local}@{head}', key)}.{tail}"


def _phone(text: str, key: str) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+", text)
    head = code[0] if code else ""
    return head + respell(text[len(head) :], key)


def _secret(text: str, key: str) -> str:
    if _is_hex(text):
        return respell(text, key + ":hex", lambda c: (HEX, HEX.index(c)))
    made = respell(text, key)
    while _is_hex(made):
        made = respell(made, key)
    return made


def _is_hex(text: str) -> bool:
    return all(c in "0123456789abcdefABCDEF" for c in text)


def _name(text: str, key: str) -> str:
    out = []
    for part in re.split(r"([ -])", text):
        names = _NAME_LIST.get(part.lower())
        if names:
            made = names[permute(names.index(part.lower()), len(names), key)]
            out.append(made.upper() if part.isupper() and len(part) > 1 else made.capitalize())
        else:
            # listed names come from their list only: what would read as one is passed over
            end = part[-1:] if len(part) > 3 else ""
            made = respell(part[: len(part) - len(end)], key + ":name") + end
            while fold(made) in _NAME_LIST:
                made = respell(made[: len(made) - len(end)], key + ":name") + end
            out.append(made)
    return "".join(out)


_MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": respell, "phone": _phone, "name": _name}


def surrogate(kind: str, text: str, key: str = KEY) -> str:
    """The made-up entity in place of this one."""
    return _kept(kind, text, key) if len(text) <= LONG else _made(kind, text, key)


@lru_cache(maxsize=20_000)
def _kept(kind: str, text: str, key: str) -> str:
    return _made(kind, text, key)


def _made(kind: str, text: str, key: str) -> str:
    plain = _ascii_digits(text) if kind in ("iban", "ip", "card", "ssn", "phone") else text
    if plain == text:
        return _MAKERS[kind](text, f"{key}:{kind}")
    # other scripts' digits stay in their script, place by place; addresses keep their widths
    if kind == "ip":
        made = ".".join(_other_digits(p, f"{key}:{kind}:{i}:{len(p)}") for i, p in enumerate(plain.split(".")))
    else:
        made = _MAKERS[kind](plain, f"{key}:{kind}")
    return "".join(n if o.isascii() or not n.isdigit() else chr(ord(o) - unicodedata.decimal(o) + int(n)) for o, n in zip(text, made, strict=True))


def _ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _other_digits(part: str, key: str) -> str:
    """One part of an address among those of its width."""
    return str(permute(int(part), (10, 100, 256)[len(part) - 1], key)).zfill(len(part))


def _named(m: re.Match) -> int:
    """How many of the matched words make a name: those of upper case, or behind some titles
    one of lower case."""
    words = m["v"].split(" ")
    n = next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))
    if "t" not in m.re.groupindex:
        return n if n > 1 and words[n - 1][-1] != "." else 0  # a given name alone may be any word
    low = words[0].lower()
    if not n and m["t"].lower() in SURE_TITLES and words[0] == low and len(low) > 2 and low not in NO_NAMES:
        n = 1
    return n


class _Taken:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.spans: list[tuple[str, int, int]] = []

    def free(self, begin: int, end: int) -> bool:
        at = bisect_left(self.begins, begin)
        return (at == 0 or self.spans[at - 1][2] <= begin) and (at == len(self.begins) or self.begins[at] >= end)

    def merge(self, found: list[tuple[str, int, int]]) -> None:
        """Adds spans that are free and in order among themselves."""
        self.spans = sorted([*self.spans, *found], key=lambda s: s[1])
        self.begins = [b for _, b, _ in self.spans]


_WORD = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"[\w]")


def detect(text: str) -> list[tuple[str, int, int]]:
    """(type, begin, end) of the entities of a text, in order, none overlapping another."""
    sought = _sought(text)
    taken = _Taken()
    for kind, pattern in _COMPILED:
        if kind not in sought:
            continue
        found: list[tuple[str, int, int]] = []
        for m in pattern.finditer(text):
            begin, end = m.span("v") if "v" in pattern.groupindex else m.span()
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "name":
                n = _named(m)
                end = begin + len(" ".join(m["v"].split(" ")[:n]))
                if not n:
                    continue
            if (not found or found[-1][2] <= begin) and taken.free(begin, end):
                found.append((kind, begin, end))
        if found:
            taken.merge(found)
    # later mentions of a part of a name, without the title
    parts = {w.lower() for k, b, e in taken.spans if k == "name" for w in re.split("[ .-]+", text[b:e]) if len(w) > 2}
    if parts:
        more = []
        for m in _WORD.finditer(text):
            if m[0].lower() in parts and m[0][0].isupper() and not (m.start() and _INSIDE.match(text[m.start() - 1])) and not (m.end() < len(text) and _INSIDE.match(text[m.end()])) and taken.free(*m.span()):
                more.append(("name", *m.span()))
        taken.merge(more)
    return taken.spans


def anonymize(text: str, key: str = KEY) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    out, spans, at, shift = [], [], 0, 0
    for kind, begin, end in detect(text):
        made = surrogate(kind, text[begin:end], key)
        out += [text[at:begin], made]
        spans.append({"kind": kind, "start": begin + shift, "end": begin + shift + len(made)})
        shift += len(made) - (end - begin)
        at = end
    return "".join([*out, text[at:]]), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def replace(docs: DataFrame, key: str = KEY, spans: str | None = None) -> DataFrame:
    """``docs``, all columns, with surrogates in text (and n_chars, where there is one, to
    match it); the column ``spans``, if named, tells the type and place of each."""
    names = [f.name for f in docs.schema.fields if f.name != spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(names.index("text")).to_pylist()
                done = [(None, []) if t is None else anonymize(t, key) for t in texts]
                columns = list(part.columns)
                columns[names.index("text")] = pa.array([t for t, _ in done], pa.string())
                if "n_chars" in names:
                    at = names.index("n_chars")
                    sizes = [n if n is None or t is None or t == old else len(t) for n, (t, _), old in zip(columns[at].to_pylist(), done, texts, strict=True)]
                    columns[at] = pa.array(sizes, columns[at].type)
                more = [pa.array([s for _, s in done], SPANS)] if spans else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *([spans] if spans else [])])

    out = [docs.schema[n] for n in names]
    if spans:
        out.append(T.StructField(spans, T._parse_datatype_string("array<struct<kind: string, start: int, end: int>>")))
    return map_batches(docs.select(*names), run, T.StructType(out))


def collisions(pairs: DataFrame) -> DataFrame:
    """Of (kind, entity, surrogate) rows the surrogates that stand for several entities."""
    folded = lambda c: F.translate(F.lower(c), "ς", "σ").alias(c)
    distinct = pairs.select("kind", folded("entity"), folded("surrogate")).distinct()
    return distinct.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
