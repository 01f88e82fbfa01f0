"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own
(an offset and a stride taken from hashes of its name).  The shards take turns;
each claims the first slot of its order that is still free.  So every shard gets
as many slots as any other, give or take one, and when a shard is added or
removed few slots change hands besides its own.

The table's size is a parameter, whatever the input's, so it is sent to all
tasks; placing a row is one hash and one array access.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import unused

#: Production parameters: a prime, and the shards' names.
SLOTS = 65537
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be some distinct names")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, at least the number of shards")
    orders = [(_number(s, "offset") % slots + (_number(s, "stride") % (slots - 1) + 1) * np.arange(slots)) % slots for s in shards]
    owner, at, claimed = np.full(slots, -1), [0] * len(shards), 0
    while claimed < slots:
        for i, order in enumerate(orders[: slots - claimed]):
            while owner[slot := order[at[i]]] >= 0:
                at[i] += 1
            owner[slot] = i
            claimed += 1
    return owner.tolist()


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """60 bits of the MD5 of the key's text, modulo the table's size; a null key has the slot of an empty text."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str = "doc_id", *, shards: list[str] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard's name of each row, in the columns named (in place of columns of these names).

    Rows with one key share a shard; rows with a null key go where an empty text
    goes; an empty table stays empty.  Choose a key with many values: a hot key can only be in one shard.
    """
    # a literal: Catalyst folds it to one array, which goes to the tasks with the code
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    names = F.array(*map(F.lit, shards))
    placed = df.withColumn(slot_col, slot_of(key, slots))
    return placed.withColumn(shard_col, F.get(names, F.get(owners, F.col(slot_col).cast("int"))))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", *, shards: list[str] = SHARDS, slots: int = SLOTS, parts: int = 1) -> None:
    """Write ``df`` as Parquet in one folder for each shard, in about ``parts`` files each.

    A column ``shard`` is replaced.  A salt from the key and the row's task deals
    a shard's rows over ``parts`` tasks, those of a hot key too.
    """
    slot = unused("slot", df.columns)
    placed = place(df, key, shards=shards, slots=slots, slot_col=slot, shard_col="shard").drop(slot)
    salt = F.pmod(F.xxhash64(F.col(key)) + F.spark_partition_id(), F.lit(parts))
    placed.repartition(len(shards) * parts, "shard", salt).write.partitionBy("shard").parquet(path)
