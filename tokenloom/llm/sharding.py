"""Operator 9 [native], sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, a permutation
given by an offset and a skip. The shards take turns, each claiming the first free slot it
prefers, until the table is full: all shards get the same number of slots within one, and
adding or removing a shard moves few other slots. The table has ``slots`` rows, whatever
the input, so it is broadcast, and placing a row is one hash and one lookup. The fill is
driver-side integer arithmetic over the fixed table; rows are placed by SQL functions alone.

Defined results: a null key is placed like the empty string; equal keys share a shard;
an empty table gives an empty result; other columns are left alone in ``assign``, which
adds ``slot`` and ``shard`` (replacing columns of these names)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The production setting of the registered query: a prime over 100 times the shards keeps
#: shard sizes within a percent.
SHARDS = 32
SLOTS = 4093


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill_table(names: list[str], slots: int) -> list[int]:
    """The shard (its index in ``names``) of every slot."""
    if slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots has to be a prime, no smaller than the number of shards")
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names have to be distinct, one at least")
    table, at = [-1] * slots, [preference(n, slots) for n in names]
    tried = [0] * len(names)
    for turn in range(slots):
        shard = turn % len(names)
        offset, skip = at[shard]
        while table[slot := (offset + tried[shard] * skip) % slots] >= 0:
            tried[shard] += 1
        table[slot] = shard
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def assign(rows: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``rows`` with their slot and shard."""
    table = fill_table(names or shard_names(SHARDS), slots)
    listed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    lookup = rows.sparkSession.range(1).select(F.posexplode(listed).alias("slot", "shard"))
    placed = rows.drop("slot", "shard").withColumn("slot", (key_hash(F.col(key)) % slots).cast("int"))
    return placed.join(F.broadcast(lookup), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def oracle(shards: int, slots: int, table: str, key: str) -> str:
    """DuckDB SQL that fills the table turn by turn and places the rows."""
    digest = "md5(concat('shard-', s))"
    return f"""
with recursive shard as (
  select s, ('0x' || substr({digest}, 1, 15))::bigint % {slots} o, ('0x' || substr({digest}, 16, 15))::bigint % {slots - 1} + 1 k
  from range({shards}) t(s)),
fill as (
  select 0 turn, list_transform(range({slots}), lambda i: -1) taken, -1::bigint slot, -1::bigint s
  union all
  select turn + 1, list_concat(list_concat(taken[1:c], [w]), taken[c + 2:]), c, w from (
    select f.turn, f.taken, shard.s w,
      (shard.o + list_filter(range({slots}), lambda j: f.taken[1 + (shard.o + j * shard.k) % {slots}] < 0)[1] * shard.k) % {slots} c
    from fill f join shard on shard.s = f.turn % {shards} where f.turn < {slots})),
placed as (select {key}, (('0x' || substr(md5(coalesce({key}::varchar, '')), 1, 15))::bigint % {slots})::int slot from {table})
select {key}, placed.slot, fill.s::int shard from placed join fill on fill.slot = placed.slot where fill.turn > 0"""
