"""Decoding of id columns and lookups in vocabularies."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import decoders
from tokenloom.kernels import batches
from tokenloom.kernels.bpe import Bpe, alphabet_bytes
from tokenloom.kernels.byte_rank import ByteRank
from tokenloom.kernels.wordpiece import WordPiece
from tokenloom.operators.encode import broadcast_model
from tokenloom.spec import TokenizerSpec

#: Vocabularies up to this many rows are broadcast to joins; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def vocabulary(spark: SparkSession, vocab: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(vocab.items()), "token string, id int")


def _small(vocab: DataFrame) -> DataFrame:
    return F.broadcast(vocab) if vocab.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else vocab


def token_to_id(rows: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Rows with the id of their token, null where there is none."""
    return rows.join(_small(vocab.select(F.col("token").alias(token), "id")), token, "left")


def id_to_token(rows: DataFrame, vocab: DataFrame, id_: str = "id") -> DataFrame:
    """Rows with the token of their id, null where there is none."""
    return rows.join(_small(vocab.select(F.col("id").alias(id_), "token")), id_, "left")


def to_external(id_: Column) -> Column:
    """Ids of models whose ids are moved by one from 4 on, as seen from outside."""
    return F.when(id_ >= 4, id_ + 1).otherwise(id_)


def to_internal(id_: Column) -> Column:
    return F.when(id_ >= 4, id_ - 1).otherwise(id_)


class _Table:
    """What ids stand for, by array operations; ids without an entry stand for the last one."""

    def __init__(self, spelled: dict[int, object], other: object, kind: pa.DataType):
        known = sorted(i for i in spelled if i >= 0)
        self.ids = np.array(known, np.int64)
        self.values = pa.array([*(spelled[i] for i in known), other], kind)
        self.dense = None  # the place of each id, where ids leave few gaps
        if known and known[-1] < 16 * len(known) + 1024:
            self.dense = np.full(known[-1] + 2, len(known), np.int32)
            self.dense[self.ids] = np.arange(len(known))

    def places(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        if self.dense is not None:
            last = len(self.dense) - 1  # stands for all ids that aren't there
            return self.dense[np.where((ids < 0) | (ids > last), last, ids)]
        at = np.searchsorted(self.ids, ids)
        return np.where(self.ids[np.minimum(at, len(self.ids) - 1)] == ids, at, len(self.ids))

    def rows(self, ids: np.ndarray, first: np.ndarray, kept: np.ndarray, lost: np.ndarray) -> pa.ListArray:
        """The values of the kept ids of each row."""
        edges = np.concatenate([[0], np.cumsum(kept)])[first]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), self.values.take(pa.array(self.places(ids[kept]))), mask=pa.array(lost))


class _Glued(_Table):
    """Words of pieces: those with the prefix go on with the word before, the others start one."""

    def __init__(self, spelled: dict[int, str], prefix: str):
        head = {i: t[len(prefix) :] if t.startswith(prefix) else t for i, t in spelled.items()}
        super().__init__(head, "", pa.string())
        later = [t[len(prefix) :] if t.startswith(prefix) else f" {t}" for t in (spelled[i] for i in self.ids.tolist())]
        self.values = pa.concat_arrays([self.values, pa.array(later, pa.string())])

    def texts(self, ids: np.ndarray, first: np.ndarray, lost: np.ndarray) -> pa.Array:
        """Each row's pieces in one text, unknown ids left out."""
        place = self.places(ids).astype(np.int64)
        kept = place < len(self.ids)
        edges = np.concatenate([[0], np.cumsum(kept)])[first]
        place = place[kept] + len(self.ids) + 1
        heads = edges[:-1][np.diff(edges) > 0]
        place[heads] -= len(self.ids) + 1
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), self.values.take(pa.array(place)), mask=pa.array(lost)), "")


#: Ids that are spelled at a time.
_IDS = 1 << 18


def _id_slices(ids: pa.ListArray):
    """Parts of a column of id lists with a bounded number of ids, one row at least: ids, where rows begin, null rows."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ids):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _IDS, side="right")))
        part = ids[at:stop]
        first, flat, lost = batches.flattened(part, part)
        yield part, pc.fill_null(flat, -1).to_numpy(zero_copy_only=False), first, lost
        at = stop


class _Speller:
    """Texts of id lists for models that decode by themselves."""

    def __init__(self, spec: TokenizerSpec):
        self.model = spec.model
        self.added = {t.id: t for t in spec.added_tokens}
        pieces = not isinstance(spec.model, (WordPiece, Bpe, ByteRank))
        self.special = {t.id for t in spec.added_tokens if t.special} | set(spec.special_ids.values()) | (spec.model.control if pieces else set())

    def __call__(self, ids: list[int], skip: bool) -> str:
        if isinstance(self.model, ByteRank):
            return self.model.decode(ids, skip)
        kept = [i for i in ids if not (skip and i in self.special)]
        if not isinstance(self.model, Bpe):
            return self._pieces(kept)
        out, run = [], []
        for i in [*kept, None]:
            if i is not None and i not in self.added:
                run.append(i)
                continue
            if run:
                out.append(self.model.decode(run))
                run = []
            if i is not None:
                out.append(self.added[i].content)
        return "".join(out)

    @cached_property
    def _table(self) -> _Table | None:
        """The text or the bytes of each id; None where these depend on the ids beside it."""
        m = self.model
        if isinstance(m, ByteRank):
            return _Table(m.bytes_of, b"", pa.binary())
        if not isinstance(m, Bpe):
            return _Table({m.external(i): t.replace("▁", " ") for i, t in m.text_of.items()}, "", pa.string())
        unknown = m.options.unk_token or ""
        if m.options.byte_level:
            return _Table({i: alphabet_bytes(t) for i, t in m.token_of.items()}, alphabet_bytes(unknown), pa.binary())
        return None if m.options.suffix else _Table(m.token_of, unknown, pa.string())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def column(self, ids: pa.ListArray, skip: bool) -> pa.Array:
        """The texts of all rows; those with added tokens are spelled one by one."""
        parts = [self._part(*x, skip) for x in _id_slices(ids)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _part(self, ids: pa.ListArray, flat: np.ndarray, first: np.ndarray, lost: np.ndarray, skip: bool) -> pa.Array:
        if self._table is None:
            return pa.array([None if x is None else self(x, skip) for x in ids.to_pylist()], pa.string())
        rank = isinstance(self.model, ByteRank)
        kept = ~np.isin(flat, list(self.special)) if skip and not rank else np.ones(len(flat), bool)
        apart = np.concatenate([[0], np.cumsum(kept & np.isin(flat, list(self.model.special_of if rank else self.added)))])
        made = pc.binary_join(self._table.rows(flat, first, kept, lost), b"" if pa.types.is_binary(self._table.values.type) else "")
        if pa.types.is_binary(made.type):
            made = pa.array([None if b is None else b.decode(errors="replace") for b in made.to_pylist()], pa.string())
        elif not isinstance(self.model, Bpe):
            made = pc.utf8_trim(made, " ")
        odd = np.flatnonzero((apart[first[1:]] > apart[first[:-1]]) & ~lost).tolist()
        if odd:
            texts = made.to_pylist()
            for d in odd:
                texts[d] = self(flat[first[d] : first[d + 1]].tolist(), skip)
            made = pa.array(texts, pa.string())
        return made

    def _pieces(self, ids: list[int]) -> str:
        """Spaces at the ends go only where no added token stands."""
        runs: list[str | list[int]] = []
        for i in ids:
            if i in self.added:
                runs.append(self.added[i].content)
            elif runs and isinstance(runs[-1], list):
                runs[-1].append(i)
            else:
                runs.append([i])
        spelled = [r if isinstance(r, str) else "".join(self.model.text_of.get(self.model.internal(i), "") for i in r).replace("▁", " ") for r in runs]
        if runs and isinstance(runs[0], list):
            spelled[0] = spelled[0].lstrip(" ")
        if runs and isinstance(runs[-1], list):
            spelled[-1] = spelled[-1].rstrip(" ")
        return "".join(spelled)


def decode(df: DataFrame, spec: TokenizerSpec, ids: str = "ids", output: str = "decoded", skip_special_tokens: bool = False) -> DataFrame:
    """``df`` with the texts of an id column. WordPiece uses its decoder's expressions over
    the tokens, unknown ids dropped; the other models decode by themselves."""
    spark = df.sparkSession
    if isinstance(spec.model, WordPiece):
        o = spec.model.options
        skipped = {o.cls_token, o.sep_token, o.pad_token, o.mask_token} if skip_special_tokens else set()
        shared = broadcast_model(spark, spec.model)

        own = decoders.from_config(spec.decoder) if spec.decoder else None
        known = lambda: {i: t for t, i in shared.value.vocab.items() if t not in skipped}

        @F.arrow_udf("array<string>")
        def tokens(column: pa.Array) -> pa.Array:
            table = _Table(known(), None, pa.string())
            parts = [table.rows(flat, first, table.places(flat) < len(table.ids), lost) for _, flat, first, lost in _id_slices(column)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

        @F.arrow_udf("string")
        def glued(column: pa.Array) -> pa.Array:
            table = _Glued(known(), o.prefix)
            parts = [table.texts(flat, first, lost) for _, flat, first, lost in _id_slices(column)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

        if own:
            return df.withColumn("__tokens", tokens(ids)).withColumn(output, own(F.col("__tokens"))).drop("__tokens")
        return df.withColumn(output, decoders.wordpiece_cleanup(glued(ids)) if o.clean_up else glued(ids))
    speller = broadcast_model(spark, _Speller(spec))

    @F.arrow_udf("string")
    def spell(column: pa.Array) -> pa.Array:
        return speller.value.column(column, skip_special_tokens)

    return df.withColumn(output, spell(ids))
