"""Encodings (spec.ENCODING) as sets of columns: building, specials, pairs, truncation, padding.
All of it is array expressions that stay in the JVM; no function shuffles. An ``Enc`` holds one
column per field, so that composing steps keeps each expression small; ``column()`` packs it
into a struct."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tokenloom.functions.normalizers import SPACE_CLASS
from tokenloom.spec import ENCODING, WINDOW, Padding, Truncation

FIELDS = [f.name for f in WINDOW.fields]
_TYPES = {f.name: f.dataType for f in ENCODING.fields}


@dataclass(frozen=True)
class Enc:
    """One column per field; overflow windows, where there can be any; where sequences stand."""

    fields: dict[str, Column]
    overflow: Column | None = None
    ranges: dict[int, tuple[Column, Column]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Column:
        return self.fields[name]

    def with_(self, **fields: Column) -> Enc:
        return replace(self, fields=self.fields | fields)

    def overflowing(self) -> Column:
        return F.array().cast(_TYPES["overflowing"]) if self.overflow is None else self.overflow

    def column(self) -> Column:
        spans = [(F.lit(k), F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))) for k, (a, b) in self.ranges.items()]
        ranges = F.create_map(*[x for pair in spans for x in pair]) if spans else F.create_map()
        return F.struct(*[self[n].alias(n) for n in FIELDS], self.overflowing().alias("overflowing"), ranges.cast(_TYPES["sequence_ranges"]).alias("sequence_ranges"))


def _spot(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _blank() -> dict[str, Column]:
    none = F.lit(0)
    return {"type_ids": none, "words": F.lit(None).cast("int"), "offsets": _spot(none, none), "special_tokens_mask": none, "attention_mask": F.lit(1)}


def _constant(ids: Column, value: Column) -> Column:
    """The value once for each id."""
    return F.when(ids.isNotNull(), F.array_repeat(value, F.size(ids)))


def encoding(parts: dict[str, Column]) -> Enc:
    """An encoding of the given columns; missing ones follow from ids."""
    ids = parts["ids"]
    fill = {n: _constant(ids, x) for n, x in _blank().items()} | {"tokens": F.transform(ids, lambda x: x.cast("string"))}
    return Enc({n: parts.get(n, fill.get(n)).cast(_TYPES[n]) for n in FIELDS})


def of(column: Column, overflow: bool = False) -> Enc:
    """The encoding in a struct column; its windows too, if it can have any."""
    return Enc({n: column[n] for n in FIELDS}, column["overflowing"] if overflow else None)


def from_pieces(pieces: Column, type_id: int = 0) -> Enc:
    """The encoding of what a kernel returned."""
    return with_type(encoding({n: pieces[n] for n in ("ids", "tokens", "offsets", "words")}), type_id)


def size(enc: Enc) -> Column:
    return F.size(enc["ids"])


def token(id_: int, text: str, type_id: int = 0) -> Enc:
    """An encoding of one special token."""
    one = {n: F.array(x) for n, x in _blank().items()}
    return Enc({n: x.cast(_TYPES[n]) for n, x in (one | {"ids": F.array(F.lit(id_)), "tokens": F.array(F.lit(text)), "type_ids": F.array(F.lit(type_id)), "special_tokens_mask": F.array(F.lit(1))}).items()})


def set_sequence(enc: Enc, sequence: int) -> Enc:
    """Marks all of an encoding as this sequence."""
    return replace(enc, ranges={sequence: (F.lit(0), size(enc))})


def _window(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[n].alias(n) for n in FIELDS])


def _joined(a, b, growing: bool) -> dict[str, Column]:
    made = {n: F.concat(a[n], b[n]) for n in FIELDS}
    if growing:
        base = F.coalesce(F.try_element_at(a["offsets"], F.lit(-1))["end"], F.lit(0))
        made["offsets"] = F.concat(a["offsets"], F.transform(b["offsets"], lambda o: _spot(o["start"] + base, o["end"] + base)))
    return made


def merge(parts: Sequence[Enc], growing_offsets: bool = False) -> Enc:
    """Encodings one after the other, sequence ranges moved along; offsets too, if asked for.
    Overflow windows of both sides are combined with each other and with the other side."""
    out = parts[0]
    for b in parts[1:]:
        a, over = out, []
        if a.overflow is not None:
            over.append(F.transform(a.overflow, lambda x, b=b: _window(_joined(x, b, growing_offsets))))
            if b.overflow is not None:
                over.append(F.flatten(F.transform(a.overflow, lambda x, b=b: F.transform(b.overflow, lambda y: _window(_joined(x, y, growing_offsets))))))
        if b.overflow is not None:
            over.append(F.transform(b.overflow, lambda y, a=a: _window(_joined(a, y, growing_offsets))))
        moved = {k: (s + size(a), e + size(a)) for k, (s, e) in b.ranges.items()}
        out = Enc(_joined(a, b, growing_offsets), F.concat(*over) if over else None, a.ranges | moved)
    return out


def truncate(enc: Enc, length: Column | int, side: str = "right", stride: int = 0) -> Enc:
    """At most ``length`` tokens of the head (right) or tail (left); with a stride the rest
    becomes overflow windows, each reaching back into the one before."""
    n = F.greatest(F.lit(length) if isinstance(length, int) else length, F.lit(0))
    count = size(enc)
    begin = F.lit(1) if side == "right" else F.greatest(count - n, F.lit(0)) + 1
    over = enc.overflow
    if stride > 0:
        starts = F.when((count > n) & (n > 0), F.sequence(n, F.greatest(count - 1, n), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        at = lambda s: F.greatest(s - stride, F.lit(0))
        over = F.transform(starts, lambda s: _window({f: F.slice(enc[f], at(s) + 1, F.least(s + n, count) - at(s)) for f in FIELDS}))
    return Enc({f: F.slice(enc[f], begin, n) for f in FIELDS}, over, enc.ranges)


def truncate_pair(a: Enc, b: Enc, budget: Column | int, strategy: str = "longest_first", side: str = "right", stride: int = 0) -> tuple[Enc, Enc]:
    """Two encodings with ``budget`` tokens together at most."""
    k = F.greatest(F.lit(budget) if isinstance(budget, int) else budget, F.lit(0))
    na, nb = size(a), size(b)
    name = strategy.replace("_", "").replace("-", "").lower()
    if name == "onlyfirst":
        return truncate(a, F.least(na, F.greatest(k - nb, F.lit(0))), side, stride), b
    if name == "onlysecond":
        return a, truncate(b, F.least(nb, F.greatest(k - na, F.lit(0))), side, stride)
    # one token at a time from the longer, the first on ties, in closed form
    low, high = F.floor(k / 2).cast("int"), F.ceil(k / 2).cast("int")
    keep = F.when(na + nb <= k, na).when(na <= low, na).when(nb <= high, k - nb).otherwise(low)
    rest = F.when(na + nb <= k, nb).otherwise(k - keep)
    return truncate(a, keep, side, stride), truncate(b, rest, side, stride)


def pad(enc: Enc, length: Column | int, side: str = "right", pad_id: int = 0, pad_type_id: int = 0, pad_token: str = "[PAD]") -> Enc:
    """Up to ``length`` tokens; padding has no attention and counts as special."""
    more = F.greatest((F.lit(length) if isinstance(length, int) else length) - size(enc), F.lit(0))
    none = _blank() | {"ids": F.lit(pad_id), "tokens": F.lit(pad_token), "type_ids": F.lit(pad_type_id), "special_tokens_mask": F.lit(1), "attention_mask": F.lit(0)}
    blank = {n: F.array_repeat(x, more).cast(_TYPES[n]) for n, x in none.items()}
    return enc.with_(**{n: F.concat(enc[n], blank[n]) if side == "right" else F.concat(blank[n], enc[n]) for n in FIELDS})


def pad_to_multiple(length: Column, multiple: int) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("int") if multiple > 0 else length


def pad_configured(enc: Enc, padding: Padding) -> Enc:
    """Padding as configured: to its length, else the encoding's own, rounded up; the strategy
    isn't looked at."""
    target = F.lit(padding.length) if padding.length is not None else size(enc)
    return pad(enc, pad_to_multiple(target, padding.pad_to_multiple_of), padding.direction, padding.pad_id, padding.pad_type_id, padding.pad_token)


def truncate_configured(enc: Enc, truncation: Truncation, added: int) -> Enc:
    """Truncation as configured, room left for the special tokens that follow."""
    return truncate(enc, max(0, truncation.max_length - added), truncation.direction, truncation.stride)


def batch_longest(enc: Enc, batch: Column) -> Column:
    """The largest number of tokens among the rows of a batch. Batches have to be small
    groups named by the caller: a table has no batches of its own."""
    return F.max(size(enc)).over(Window.partitionBy(batch))


def _clear_specials(enc: Enc) -> Enc:
    return enc.with_(special_tokens_mask=_constant(enc["ids"], F.lit(0)))


def with_type(enc: Enc, type_id: int) -> Enc:
    return enc.with_(type_ids=_constant(enc["ids"], F.lit(type_id)))


@dataclass(frozen=True)
class PostProcessor:
    """How special tokens surround one encoding or a pair, and how many they are."""

    single: Callable[[Enc], Enc]
    pair: Callable[[Enc, Enc], Enc]
    added_single: int = 0
    added_pair: int = 0

    def __call__(self, a: Enc, b: Enc | None = None, add_special_tokens: bool = True) -> Enc:
        if not add_special_tokens:
            return a if b is None else merge([set_sequence(a, 0), set_sequence(b, 1)])
        return self.single(a) if b is None else self.pair(a, b)


def plain() -> PostProcessor:
    return PostProcessor(lambda a: a, lambda a, b: merge([set_sequence(a, 0), set_sequence(with_type(b, 1), 1)]))


def bert(cls: tuple[str, int], sep: tuple[str, int]) -> PostProcessor:
    # columns are made when called: a processor can be defined before any session is there
    c, s = (lambda: token(cls[1], cls[0])), (lambda k=0: token(sep[1], sep[0], k))
    own = lambda x, k: set_sequence(with_type(_clear_specials(x), k), k)
    return PostProcessor(lambda a: merge([c(), own(a, 0), s()]), lambda a, b: merge([c(), own(a, 0), s(), own(b, 1), s(1)]), 2, 3)


def roberta(cls: tuple[str, int], sep: tuple[str, int], trim_offsets: bool = True, add_prefix_space: bool = True) -> PostProcessor:
    c, s = (lambda: token(cls[1], cls[0])), (lambda: token(sep[1], sep[0]))

    def own(x: Enc, k: int) -> Enc:
        x = trim_byte_level(x, add_prefix_space) if trim_offsets else x
        return set_sequence(with_type(x, 0), k)

    return PostProcessor(lambda a: merge([c(), own(a, 0), s()]), lambda a, b: merge([c(), own(a, 0), s(), s(), own(b, 1), s()]), 2, 4)


def template(single: Sequence[str], pair: Sequence[str] | None, specials: dict[str, tuple[list[int], list[str]]]) -> PostProcessor:
    """From pieces such as ["[CLS]:0", "$A:0", "[SEP]:0"]; without a pair template the single
    one serves. Where the first and last specials are <s> and </s>, the other layout of
    that pair of tokens is used."""
    pair = pair or single
    named = [p.rpartition(":")[0] if ":" in p else p for p in single]
    marks = [p for p in named if not p.startswith("$")]
    if len(marks) > 1 and marks[0] == "<s>" and marks[-1] == "</s>":
        return roberta(("<s>", specials["<s>"][0][0]), ("</s>", specials["</s>"][0][0]), trim_offsets=False)

    def build(pieces: Sequence[str], given: dict[str, Enc]) -> Enc:
        parts = []
        for p in pieces:
            name, _, kind = p.rpartition(":") if ":" in p else (p, "", "0")
            type_id = int(kind or 0)
            if name.startswith("$"):
                key = "B" if name[1:] in ("B", "1") else "A"
                if key not in given:
                    raise ValueError("the template needs a pair")
                parts.append(set_sequence(with_type(given[key], type_id), int(key == "B")))
            else:
                parts += [token(i, t, type_id) for i, t in zip(*specials[name], strict=True)]
        return merge(parts)

    count = lambda pieces: sum(len(specials[n][0]) for p in pieces for n in [p.rpartition(":")[0] if ":" in p else p] if not n.startswith("$"))
    return PostProcessor(lambda a: build(single, {"A": a}), lambda a, b: build(pair, {"A": a, "B": b}), count(single), count(pair))


def trim_byte_level(enc: Enc, add_prefix_space: bool = False) -> Enc:
    """Offsets without the leading and trailing spaces of byte-level tokens; the first token
    keeps one leading space where a prefix space was added."""
    space = rf"Ġ{SPACE_CLASS}"

    def trimmed(t: Column, o: Column, first: Column | None) -> Column:
        lead = F.length(t) - F.length(F.regexp_replace(t, f"^[{space}]+", ""))
        trail = F.length(t) - F.length(F.regexp_replace(t, rf"[{space}]+\z", ""))
        if first is not None:
            lead = F.when(first & (o["start"] == 0) & (lead > 0), lead - 1).otherwise(lead)
        start = F.least(o["start"] + lead, o["end"])
        return _spot(start, F.greatest(start, o["end"] - F.when(lead >= F.length(t), F.lit(0)).otherwise(trail)))

    zipped = F.arrays_zip(enc["tokens"].alias("t"), enc["offsets"].alias("o"))
    return enc.with_(offsets=F.transform(zipped, lambda z, i: trimmed(z["t"], z["o"], i == 0 if add_prefix_space else None)))


def byte_level(add_prefix_space: bool = False, trim_offsets: bool = True) -> PostProcessor:
    own = lambda x: trim_byte_level(x, add_prefix_space) if trim_offsets else x
    return PostProcessor(own, lambda a, b: merge([set_sequence(own(a), 0), set_sequence(own(b), 1)]))


def in_turn(parts: Sequence[PostProcessor]) -> PostProcessor:
    """Each processor gets the one result of that before it: only the first sees a pair."""

    def single(a: Enc) -> Enc:
        for p in parts:
            a = p.single(a)
        return a

    def pair(a: Enc, b: Enc) -> Enc:
        out = parts[0].pair(a, b)
        for p in parts[1:]:
            out = p.single(out)
        return out

    return PostProcessor(single, pair, sum(p.added_single for p in parts), sum(p.added_pair for p in parts))


def sequence_ids(enc: Enc) -> Column:
    """For each token the number of its sequence, or null."""

    def holder(i: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, (start, end) in enc.ranges.items():
            out = F.when((i >= start) & (i < end), F.lit(k)).otherwise(out)
        return out

    each = F.transform(enc["ids"], lambda _, i: holder(i))
    # runs of one value each, where the sequences stand one behind the other
    n, at, runs, ordered = F.size(enc["ids"]), F.lit(0), [], F.lit(True)
    for k, (start, end) in enc.ranges.items():
        begin, stop = F.least(start, n), F.least(end, n)
        ordered &= (start >= at) & (end >= start)
        runs += [F.array_repeat(F.lit(None).cast("int"), begin - at), F.array_repeat(F.lit(k), stop - begin)]
        at = stop
    return F.when(ordered, F.concat(*runs, F.array_repeat(F.lit(None).cast("int"), n - at))).otherwise(each)


def n_sequences(enc: Enc) -> int:
    return max(1, len(enc.ranges))


def token_to_sequence(enc: Enc, index: Column | int) -> Column:
    """The sequence of the token at this place, or null."""
    return F.get(sequence_ids(enc), F.lit(index) if isinstance(index, int) else index)


def from_config(config: dict | None) -> PostProcessor:
    """A post-processor from its JSON."""
    if isinstance(config, PostProcessor):  # a component of the user's own
        return config
    if not config:
        return plain()
    kind = str(config.get("type", "")).lower()
    special = lambda key, text, i: _special_pair(config.get(key), text, i)
    if kind in ("bertprocessing", "bert"):
        return bert(special("cls", "[CLS]", 101), special("sep", "[SEP]", 102))
    if kind in ("robertaprocessing", "roberta"):
        return roberta(special("cls", "<s>", 0), special("sep", "</s>", 2), config.get("trim_offsets", True), config.get("add_prefix_space", True))
    if kind == "bytelevel":
        return byte_level(bool(config.get("add_prefix_space")), config.get("trim_offsets", True))
    if kind == "sequence":
        return in_turn([from_config(p) for p in config.get("processors") or []] or [plain()])
    if kind in ("templateprocessing", "template"):
        tokens = {k: (list(v.get("ids", [])), list(v.get("tokens", []))) for k, v in (config.get("special_tokens") or {}).items()}
        written = lambda items: [_template_piece(p) for p in items or []]
        return template(written(config.get("single")), written(config.get("pair")) or None, tokens)
    return plain()


def _template_piece(piece: str | dict) -> str:
    if isinstance(piece, str):
        return piece if ":" in piece else f"{piece}:0"
    ((kind, body),) = piece.items()
    name = f"${body.get('id', 'A')}" if kind == "Sequence" else body["id"]
    return f"{name}:{body.get('type_id', 0)}"


def _special_pair(value, text: str, id_: int) -> tuple[str, int]:
    """[token, id] in either order."""
    if not value:
        return text, id_
    a, b = value
    return (a, int(b)) if isinstance(a, str) else (b, int(a))
