"""Queries of truncation, padding, pairs and post-processing, over encodings built from the
lines of each order: the part keys, in line order, are the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import encodings as X
from tokenloom.spec import Padding, Truncation

BERT = X.bert(("[CLS]", 101), ("[SEP]", 102))
ROBERTA = X.roberta(("<s>", 0), ("</s>", 2), trim_offsets=False)
TEMPLATE = X.template(["[CLS]:0", "$A:0", "[SEP]:0"], ["[CLS]:0", "$A:0", "[SEP]:0", "$B:1", "[SEP]:1"], {"[CLS]": ([101], ["[CLS]"]), "[SEP]": ([102], ["[SEP]"])})
#: Orders whose lines a batch holds.
BATCH = 32


def _orders(spark, sf_dir):
    """One row an order: an encoding of its part keys and one of its supplier keys. At most
    seven lines belong to an order, so the lists are bounded."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("int").alias("p"), F.col("l_suppkey").cast("int").alias("s")))).alias("x"))
    made = lambda name: X.encoding({"ids": F.transform("x", lambda r: r[name]), "offsets": F.transform("x", lambda r, i: F.struct((i * 2).alias("start"), (i * 2 + 1).alias("end")))})
    return rows.select("l_orderkey", made("p").column().alias("a"), made("s").column().alias("b"))


def _joined(column):
    return F.array_join(column.cast("array<string>"), " ", "-")


def _shown(enc):
    """An encoding as text columns."""
    spans = F.array_join(F.transform(enc["offsets"], lambda o: F.concat_ws("-", o["start"], o["end"])), " ")
    over = F.array_join(F.transform(enc["overflowing"], lambda w: F.array_join(F.transform(w["ids"], lambda x: x.cast("string")), " ")), "|")
    return [_joined(enc["ids"]).alias("ids"), _joined(enc["type_ids"]).alias("type_ids"), _joined(enc["special_tokens_mask"]).alias("special"), _joined(enc["attention_mask"]).alias("attention"), spans.alias("offsets"), over.alias("overflow")]


def _query(fn):
    def run(spark, sf_dir):
        rows = _orders(spark, sf_dir).withColumn("e", fn(X.of(F.col("a")), X.of(F.col("b"))).column())
        return rows.select("l_orderkey", *_shown(F.col("e")))

    return run


_BASE = """with base as (select l_orderkey, list(l_partkey::int order by l_linenumber, l_partkey, l_suppkey) a, list(l_suppkey::int order by l_linenumber, l_partkey, l_suppkey) b from lineitem group by 1),
offs as (select *, list_transform(range(len(a)), lambda i: concat(2 * i, '-', 2 * i + 1)) o from base)"""


def _sql(ids: str, types: str = "", special: str = "", attention: str = "", offsets: str = "o", overflow: str = "''", before: str = "") -> str:
    """SQL of the shown columns from list expressions over a, b, o; the lists default to the
    constants that go with ids."""
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: v::varchar), ' '), '')"
    const = lambda k: f"list_transform({ids}, lambda v: {k})"
    return f"{_BASE}{before} select l_orderkey, {text(ids)} ids, {text(types or const(0))} type_ids, {text(special or const(0))} special, {text(attention or const(1))} attention, {text(offsets)} offsets, {overflow} overflow from {'calc' if before else 'offs'}"


_ZERO = "['0-0']"
_K = lambda x, k: f"list_transform({x}, lambda v: {k})"
_REP = lambda k, n: f"list_transform(range({n}), lambda v: {k})"
_CAT = lambda *x: "flatten([" + ", ".join(x) + "])"
_KEEP = lambda k: f", calc as (select *, case when len(a) + len(b) <= {k} then len(a) when len(a) <= {k} // 2 then len(a) when len(b) <= ({k} + 1) // 2 then {k} - len(b) else {k} // 2 end ka from offs)"
_WINDOWS = lambda k, s: f"coalesce(array_to_string(list_transform(range({k}, len(a), {k}), lambda p: array_to_string(list_transform(a[greatest(0, p - {s}) + 1 : least(p + {k}, len(a))], lambda v: v::varchar), ' ')), '|'), '')"

_PAIR = dict(
    ids=_CAT("[101]", "a", "[102]", "b", "[102]"),
    types=_CAT("[0]", _K("a", 0), "[0]", _K("b", 1), "[1]"),
    special=_CAT("[1]", _K("a", 0), "[1]", _K("b", 0), "[1]"),
    offsets=_CAT(_ZERO, "o", _ZERO, "o", _ZERO),
)
_SINGLE = dict(ids=_CAT("[101]", "a", "[102]"), special=_CAT("[1]", _K("a", 0), "[1]"), offsets=_CAT(_ZERO, "o", _ZERO))
_PADDED = lambda n: dict(ids=_CAT("a", _REP(9, n)), types=_CAT(_K("a", 0), _REP(1, n)), special=_CAT(_K("a", 0), _REP(1, n)), attention=_CAT(_K("a", 1), _REP(0, n)), offsets=_CAT("o", _REP("'0-0'", n)))
_LEFT = lambda n: dict(ids=_CAT(_REP(9, n), "a"), types=_CAT(_REP(1, n), _K("a", 0)), special=_CAT(_REP(1, n), _K("a", 0)), attention=_CAT(_REP(0, n), _K("a", 1)), offsets=_CAT(_REP("'0-0'", n), "o"))
_BY_BATCH = f", calc as (select *, max(len(a)) over (partition by l_orderkey // {BATCH}) longest from offs)"


def _batch_longest(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("longest", X.batch_longest(X.of(F.col("a")), F.floor(F.col("l_orderkey") / BATCH)))
    return rows.withColumn("e", X.pad(X.of(F.col("a")), F.col("longest"), "right", 9, 1).column()).select("l_orderkey", *_shown(F.col("e")))


def _pair_of(truncated):
    return X.plain().pair(*truncated)


def _merged(ids_a, ids_b, off_a="o", off_b="o"):
    return dict(ids=_CAT(ids_a, ids_b), types=_CAT(_K(ids_a, 0), _K(ids_b, 1)), offsets=_CAT(off_a, off_b))


#: name: (function of two encodings, its SQL)
CASES = {
    "post_bert_single": (lambda a, b: BERT(a), _sql(**_SINGLE)),
    "post_bert_pair": (lambda a, b: BERT(a, b), _sql(**_PAIR)),
    "post_bert_plain_pair": (lambda a, b: BERT(a, b, add_special_tokens=False), _sql(ids=_CAT("a", "b"), offsets=_CAT("o", "o"))),
    "post_roberta_pair": (lambda a, b: ROBERTA(a, b), _sql(ids=_CAT("[0]", "a", "[2, 2]", "b", "[2]"), special=_CAT("[1]", _K("a", 0), "[1, 1]", _K("b", 0), "[1]"), offsets=_CAT(_ZERO, "o", "['0-0', '0-0']", "o", _ZERO))),
    "post_template": (lambda a, b: TEMPLATE(a, b), _sql(**_PAIR)),
    "post_template_single": (lambda a, b: TEMPLATE(a), _sql(**_SINGLE)),
    "post_sequence": (lambda a, b: X.in_turn([BERT, X.plain()])(a, b), _sql(**_PAIR)),
    "post_default": (lambda a, b: X.plain()(a, b), _sql(**_merged("a", "b"))),
    "encoding_merge": (lambda a, b: X.merge([a, b], growing_offsets=True), _sql(ids=_CAT("a", "b"), offsets=_CAT("o", "list_transform(range(len(b)), lambda i: concat(2 * i + 2 * len(a) - 1, '-', 2 * i + 2 * len(a)))"))),
    "truncate_right": (lambda a, b: X.truncate(a, 3), _sql(ids="a[1:3]", offsets="o[1:3]")),
    "truncate_left": (lambda a, b: X.truncate(a, 3, "left"), _sql(ids="a[greatest(len(a) - 3, 0) + 1:]", offsets="o[greatest(len(a) - 3, 0) + 1:]")),
    "overflow_windows": (lambda a, b: X.truncate(a, 3, "right", 1), _sql(ids="a[1:3]", offsets="o[1:3]", overflow=_WINDOWS(3, 1))),
    "truncate_configured": (lambda a, b: BERT(X.truncate_configured(a, Truncation(5), BERT.added_single)), _sql(ids=_CAT("[101]", "a[1:3]", "[102]"), special=_CAT("[1]", _K("a[1:3]", 0), "[1]"), offsets=_CAT(_ZERO, "o[1:3]", _ZERO))),
    "truncate_pair_longest_first": (lambda a, b: _pair_of(X.truncate_pair(a, X.truncate(b, 4), 5)), _sql(**_merged("a[1:ka]", "b[1:5 - ka]", "o[1:ka]", "o[1:least(5 - ka, len(b))]"), before=_KEEP(5).replace("from offs", "from (select * replace (b[1:4] as b) from offs)"))),
    "truncate_pair_only_first": (lambda a, b: _pair_of(X.truncate_pair(a, b, 6, "only_first")), _sql(**_merged("a[1:greatest(6 - len(b), 0)]", "b", "o[1:greatest(6 - len(b), 0)]", "o"))),
    "truncate_pair_only_second": (lambda a, b: _pair_of(X.truncate_pair(a, b, 6, "only_second")), _sql(**_merged("a", "b[1:greatest(6 - len(a), 0)]", "o", "o[1:greatest(6 - len(a), 0)]"))),
    "pad_right": (lambda a, b: X.pad(a, 6, "right", 9, 1), _sql(**_PADDED("greatest(6 - len(a), 0)"))),
    "pad_left": (lambda a, b: X.pad(a, 6, "left", 9, 1), _sql(**_LEFT("greatest(6 - len(a), 0)"))),
    "pad_to_multiple": (lambda a, b: X.pad_configured(a, Padding(pad_id=9, pad_type_id=1, pad_to_multiple_of=4)), _sql(**_PADDED("((len(a) + 3) // 4) * 4 - len(a)"))),
    "batch_pad_max_length": (lambda a, b: X.pad(BERT(a), 10, "right", 9, 1), _sql(**{k: _CAT(v, _REP({"ids": 9, "types": 1, "special": 1, "attention": 0, "offsets": "'0-0'"}[k], "greatest(8 - len(a), 0)")) for k, v in (_SINGLE | {"types": _K(_SINGLE["ids"], 0), "attention": _K(_SINGLE["ids"], 1)}).items()})),
    "encode_options": (lambda a, b: X.pad(X.truncate(BERT(a), 5), 6, "right", 9, 1), _sql(**{k: _CAT(f"({v})[1:5]", _REP({"ids": 9, "types": 1, "special": 1, "attention": 0, "offsets": "'0-0'"}[k], "6 - least(5, len(a) + 2)")) for k, v in (_SINGLE | {"types": _K(_SINGLE["ids"], 0), "attention": _K(_SINGLE["ids"], 1)}).items()})),
}


def _sequence_ids(spark, sf_dir):
    e = BERT(X.of(F.col("a")), X.of(F.col("b")))
    return _orders(spark, sf_dir).select("l_orderkey", _joined(X.sequence_ids(e)).alias("sequences"), F.lit(X.n_sequences(e)).cast("long").alias("n"), X.token_to_sequence(e, 1).cast("long").alias("first"))


_SEQUENCES_SQL = f"{_BASE} select l_orderkey, array_to_string(list_transform({_CAT('[null]', _K('a', 0), '[null]', _K('b', 1), '[null]')}, lambda v: coalesce(v::varchar, '-')), ' ') sequences, 2::bigint n, 0::bigint as first from base"


def _byte_level_offsets(spark, sf_dir):
    """Words of part names as byte-level tokens, each but the first with its space."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("w"))
    ends = F.transform("w", lambda x, i: F.length(F.array_join(F.slice("w", 1, i + 1), " ")))
    tokens = F.transform("w", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("Ġ"), x)))
    offsets = F.transform("w", lambda x, i: F.struct((F.get(ends, i) - F.length(x) - F.when(i == 0, 0).otherwise(1)).alias("start"), F.get(ends, i).alias("end")))
    enc = X.encoding({"ids": F.transform("w", lambda x, i: i), "tokens": tokens, "offsets": offsets})
    made = X.byte_level(False)(X.of(F.col("e")))
    return rows.select("p_partkey", enc.column().alias("e")).select("p_partkey", F.array_join(F.transform(made["offsets"], lambda o: F.concat_ws("-", o["start"], o["end"])), " ").alias("offsets"))


_BYTE_LEVEL_SQL = "select p_partkey, array_to_string(list_transform(range(len(w)), lambda i: concat(length(array_to_string(w[1:i + 1], ' ')) - length(w[i + 1]), '-', length(array_to_string(w[1:i + 1], ' ')))), ' ') offsets from (select p_partkey, string_split(p_name, ' ') w from part)"


def queries() -> dict:
    return {name: _query(fn) for name, (fn, _) in CASES.items()} | {"batch_pad_longest": _batch_longest, "sequence_ids": _sequence_ids, "post_byte_level_offsets": _byte_level_offsets}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in CASES.items()} | {"batch_pad_longest": _sql(**_PADDED("longest - len(a)"), before=_BY_BATCH), "sequence_ids": _SEQUENCES_SQL, "post_byte_level_offsets": _BYTE_LEVEL_SQL}
