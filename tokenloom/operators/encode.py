"""Encoding of text columns: expressions before and behind one Arrow kernel.

A row's text crosses from the JVM to Python once. The model is broadcast once a session; each
worker keeps the pieces of words it has met. Nothing shuffles."""

from __future__ import annotations

import threading
import weakref
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import encodings as X
from tokenloom.functions import normalizers, pretokenizers
from tokenloom.kernels import batches, piece_batches
from tokenloom.kernels.bpe import AddedTokens, Bpe, BpeWithAdded
from tokenloom.kernels.pieces import lower_each
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.session import ship
from tokenloom.spec import PIECES, EncodeOptions, PaddingMode, TokenizerSpec, TruncationMode

_BROADCAST: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()
#: Bytes of texts that are cut and gathered at a time.
PART = 1 << 20
TOKEN_ROW = T.StructType().add("pos", "integer").add("token", "string").add("id", "integer").add("start", "integer").add("end", "integer")


def broadcast_model(spark: SparkSession, model: object):
    """The model's broadcast, made once an application and kept as long as the model is;
    vocabularies are files that fit the driver, whatever the size of the tables."""
    ship(spark)
    with _LOCK:
        known = _BROADCAST.setdefault(model, {})
        app = spark.sparkContext.applicationId
        if app not in known:
            known[app] = spark.sparkContext.broadcast(model)
        return known[app]


def _by_words(model, texts: pa.Array, segments: pa.Array, limit: int | None, wanted: tuple) -> pa.StructArray:
    """Pieces of segments given as an array; offsets follow from the segments' places."""
    return batches.only(batches.encode_words(model, texts, segments, limit, "offsets" in wanted), wanted)


def _by_parts(model, texts: pa.Array, limit: int | None, wanted: tuple) -> pa.StructArray:
    """Pieces by a model that cuts texts into parts and remembers these."""
    return batches.only(batches.encode_texts(model, texts, limit), wanted)


def _by_texts(model, texts: pa.Array, limit: int | None, wanted: tuple) -> pa.StructArray:
    """Pieces by a model that encodes texts whole."""
    return batches.only(_arrow([None if t is None else model.encode(t, limit) for t in texts.to_pylist()]), wanted)


def _way(model):
    """How this model gives the pieces of a column of texts (and of their segments)."""
    if isinstance(model, WordPiece):
        return _by_words
    return _by_parts if hasattr(model, "cut") else piece_batches.encode if getattr(model, "apart", False) else _by_texts


def _kernel(shared, way, limit: int | None, wanted: tuple):
    @F.arrow_udf(PIECES)
    def run(*columns: pa.Array) -> pa.Array:
        return batches.joined([way(shared.value, *(c[i:j] for c in columns), limit, wanted) for i, j in batches.slices(columns[0], PART)])

    return run


def _ids_kernel(shared, way, front: list[int], back: list[int]):
    """Ids alone, between those of specials; null text, null ids."""

    @F.arrow_udf("array<int>")
    def run(*columns: pa.Array) -> pa.Array:
        parts = [batches.surrounded(way(shared.value, *(c[i:j] for c in columns), None, ("ids",)).field("ids"), front, back) for i, j in batches.slices(columns[0], PART)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run


def _arrow(rows: list) -> pa.StructArray:
    """Pieces of all rows as one struct array; a row without a text has null fields."""
    ends = np.cumsum([0, *(len(r) if r else 0 for r in rows)], dtype=np.int32)
    flat = [p for r in rows if r for p in r]
    ids, tokens, starts, stops, words = zip(*flat, strict=True) if flat else ((),) * 5
    spots = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["start", "end"])
    lost = pa.array([r is None for r in rows], pa.bool_())
    lists = [pa.ListArray.from_arrays(pa.array(ends), x, mask=lost) for x in (pa.array(ids, pa.int32()), pa.array(tokens, pa.string()), spots, pa.array(words, pa.int32()))]
    return pa.StructArray.from_arrays(lists, names=PIECES.names)


def _source(spec: TokenizerSpec, text: Column) -> tuple[object, list[Column]]:
    """The model that encodes, and what it is given of a text column."""
    model = spec.model
    if isinstance(model, WordPiece):
        o = model.options
        normalize = normalizers.from_config(spec.normalizer) or (normalizers.lowercase if o.lowercase else lambda c: c)
        split = pretokenizers.from_config(spec.pre_tokenizer) or (pretokenizers.bert if o.basic_tokenization else pretokenizers.whitespace_split)
        clean = normalize(text)
        return model, [clean, split(clean)]
    if isinstance(model, Bpe) and spec.added_tokens:
        kind = str(spec.normalizer.get("type", "")).lower() if isinstance(spec.normalizer, dict) else ""
        model = _with_added(model, spec.added_tokens, kind == "lowercase")
    return model, [text]


def pieces(spark: SparkSession, spec: TokenizerSpec, text: Column, limit: int | None = None, wanted: tuple = tuple(PIECES.names)) -> Column:
    """The kernel's pieces of a text column: null text, null fields; also those not wanted are null."""
    model, given = _source(spec, text)
    return _kernel(broadcast_model(spark, model), _way(model), limit, wanted)(*given)


@lru_cache(maxsize=16)
def _with_added(model: Bpe, tokens: tuple, lower: bool) -> BpeWithAdded:
    return BpeWithAdded(model, AddedTokens(tokens, lower_each if lower else None))


def post_processor(spec: TokenizerSpec) -> X.PostProcessor:
    """The configured one; without one, WordPiece surrounds by [CLS] and [SEP] where the
    vocabulary has them."""
    if spec.post_processor or not isinstance(spec.model, WordPiece):
        return X.from_config(spec.post_processor)
    o, vocab = spec.model.options, spec.model.vocab
    at = lambda t, k=0: [X.token(vocab[t], t, k)] if t in vocab else []
    cls, sep = at(o.cls_token), at(o.sep_token)
    own = lambda e, k: X.set_sequence(X.with_type(e, k), k)
    return X.PostProcessor(lambda a: X.merge([*cls, own(a, 0), *sep]), lambda a, b: X.merge([*cls, own(a, 0), *sep, own(b, 1), *at(o.sep_token, 1)]), 2, 3)


def _json_applies(spec: TokenizerSpec) -> bool:
    """Truncation and padding of tokenizer.json hold for piece models only."""
    return spec.backend.startswith("SentencePiece")


def _specials(spec: TokenizerSpec, o: EncodeOptions) -> tuple[list[int], list[int]] | None:
    """The ids put before and behind those of a text; None where an encoding takes more than that."""
    if spec.post_processor or _json_applies(spec) and (spec.truncation or spec.padding) or o.max_length is not None and (o.truncation != TruncationMode.NONE or o.padding != PaddingMode.NONE):
        return None
    if not isinstance(spec.model, WordPiece) or not o.add_special_tokens:
        return [], []
    w, vocab = spec.model.options, spec.model.vocab
    return [vocab[w.cls_token]] if w.cls_token in vocab else [], [vocab[w.sep_token]] if w.sep_token in vocab else []


def encode(df: DataFrame, spec: TokenizerSpec, text: str = "text", pair: str | None = None, output: str = "encoding", options: EncodeOptions | None = None, limit: int | None = None) -> DataFrame:
    """``df`` with the encodings of a text column, or of a pair of them."""
    out, made, lost, names = _encoded(df, spec, text, pair, options, limit)
    return out.withColumn(output, F.when(~lost, made.column())).drop(*names)


def encode_fields(df: DataFrame, spec: TokenizerSpec, fields: list[str], text: str = "text", pair: str | None = None, options: EncodeOptions | None = None, limit: int | None = None) -> DataFrame:
    """``df`` with these fields of its encodings as columns; the others are neither made nor carried."""
    out, made, lost, names = _encoded(df, spec, text, pair, options, limit, tuple({"ids", *fields} & set(PIECES.names)))
    return out.withColumns({f: F.when(~lost, made[f]) for f in fields}).drop(*names)


def _encoded(df: DataFrame, spec: TokenizerSpec, text: str, pair: str | None, options: EncodeOptions | None, limit: int | None, wanted: tuple = tuple(PIECES.names)) -> tuple[DataFrame, X.Enc, Column, list[str]]:
    """``df`` with columns of pieces, the encodings made of them, whether a row has none, and those columns' names."""
    o, spark = options or EncodeOptions(), df.sparkSession
    names = ["__a", "__b"][: 1 + (pair is not None)]
    out = df
    for name, column in zip(names, [text, pair], strict=False):
        out = out.withColumn(name, pieces(spark, spec, F.col(column), limit, wanted))
    encs = [X.from_pieces(F.col(n)) for n in names]
    post = post_processor(spec)
    if _json_applies(spec) and spec.truncation:
        t = spec.truncation
        if pair is None:
            encs = [X.truncate_configured(encs[0], t, post.added_single if o.add_special_tokens else 0)]
        else:
            encs = list(X.truncate_pair(*encs, max(0, t.max_length - (post.added_pair if o.add_special_tokens else 0)), t.strategy, t.direction, t.stride))
    made = post(*encs, add_special_tokens=o.add_special_tokens)
    if limit is not None:
        made = X.truncate(made, limit)
    if _json_applies(spec) and spec.padding:
        made = X.pad_configured(made, spec.padding)
    if o.truncation != TruncationMode.NONE and o.max_length is not None:
        made = X.truncate(made, o.max_length, o.truncation_side.value)
    if o.padding != PaddingMode.NONE and o.max_length is not None:
        made = _pad(made, F.lit(o.max_length), spec, o)
    lost = F.col(names[0])["ids"].isNull() if pair is None else F.col(names[0])["ids"].isNull() | F.col(names[1])["ids"].isNull()
    return out, made, lost, names


def _pad(made: X.Enc, length: Column, spec: TokenizerSpec, o: EncodeOptions) -> X.Enc:
    p = spec.padding
    meta = (p.pad_id, p.pad_type_id, p.pad_token) if p and _json_applies(spec) else (0, 0, "[PAD]")
    return X.pad(made, length, o.padding_side.value, *meta)


def encode_batches(df: DataFrame, spec: TokenizerSpec, batch: Column, text: str = "text", output: str = "encoding", options: EncodeOptions | None = None) -> DataFrame:
    """As ``encode``; padding without a length goes to the longest row of each batch."""
    o = options or EncodeOptions()
    plain = EncodeOptions(o.add_special_tokens, o.max_length, o.truncation, o.truncation_side, PaddingMode.NONE if o.padding == PaddingMode.LONGEST or o.max_length is None else o.padding, o.padding_side)
    out = encode(df, spec, text, None, output, plain)
    if o.padding == PaddingMode.NONE or plain.padding != PaddingMode.NONE:
        return out
    widest = out.withColumn("__longest", X.batch_longest(X.of(F.col(output)), batch))
    made = _pad(X.of(F.col(output), overflow=True), F.col("__longest"), spec, o).column().withField("sequence_ranges", F.col(output)["sequence_ranges"])
    return widest.withColumn(output, F.when(F.col(output).isNotNull(), made)).drop("__longest")


def encode_to_ids(df: DataFrame, spec: TokenizerSpec, text: str = "text", output: str = "ids", options: EncodeOptions | None = None, limit: int | None = None) -> DataFrame:
    around = _specials(spec, options or EncodeOptions())
    if around is not None and limit is None:  # the kernel's ids as they are: a decoder of them runs beside it
        model, given = _source(spec, F.col(text))
        return df.withColumn(output, _ids_kernel(broadcast_model(df.sparkSession, model), _way(model), *around)(*given))
    out, made, lost, names = _encoded(df, spec, text, None, options, limit, ("ids",))
    return out.withColumn(output, F.when(~lost, made["ids"])).drop(*names)


def count_tokens(df: DataFrame, spec: TokenizerSpec, text: str = "text", output: str = "n_tokens", options: EncodeOptions | None = None) -> DataFrame:
    return encode_to_ids(df, spec, text, output, options).withColumn(output, F.size(output))


def tokens_relation(df: DataFrame, encoding: str | None = "encoding", keys: list[str] | None = None) -> DataFrame:
    """One row a token: the keys, pos, token, id, start, end. ``encoding``: the column of
    encodings; None where their fields are columns."""
    own = {encoding} if encoding else {"tokens", "ids", "offsets"}
    kept = [c for c in df.columns if c not in own] if keys is None else keys
    at = f"{encoding}." if encoding else ""
    zipped = F.arrays_zip(F.col(f"{at}tokens").alias("token"), F.col(f"{at}ids").alias("id"), F.col(f"{at}offsets").alias("o"))
    rows = df.select(*kept, F.posexplode(zipped).alias("pos", "t"))
    return rows.select(*kept, "pos", "t.token", "t.id", F.col("t.o.start").alias("start"), F.col("t.o.end").alias("end"))


def encode_to_rows(df: DataFrame, spec: TokenizerSpec, keys: list[str], text: str = "text") -> DataFrame:
    """``tokens_relation`` of the encodings of a text column. Where no expressions work on the
    pieces, workers give the rows themselves, and no arrays of a row's tokens are made."""
    spark = df.sparkSession
    if isinstance(spec.model, WordPiece) or _specials(spec, EncodeOptions()) is None:
        return tokens_relation(encode_fields(df, spec, ["ids", "tokens", "offsets"], text), None, keys)
    model, given = _source(spec, F.col(text))
    shared, way = broadcast_model(spark, model), _way(model)
    rows = df.select(*keys, *(c.alias(f"__{i}") for i, c in enumerate(given)))
    schema = T.StructType([*(df.schema[k] for k in keys), *TOKEN_ROW.fields])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = batch.columns[len(keys) :]
        for i, j in batches.slices(columns[0], PART):
            made = way(shared.value, *(c[i:j] for c in columns), None, ("ids", "tokens", "offsets"))
            ids, tokens, offsets = (made.field(n) for n in ("ids", "tokens", "offsets"))
            spots = offsets.flatten()
            yield from batches.exploded([c[i:j] for c in batch.columns[: len(keys)]], ids, [tokens.flatten(), ids.flatten(), spots.field("start"), spots.field("end")], schema.names)

    return batches.mapped(rows, run, schema)
