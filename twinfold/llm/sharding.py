"""Placing keys on shards by a lookup table that the shards fill in turns.

Every shard prefers the slots of a table of prime size in an order of its own: it starts at an offset and steps on by a
fixed skip, both from a hash of its name, and so meets every slot once. In turns each shard claims the first slot of its
order that is still free, until the table is full. Shares differ by one slot at most, and when a shard joins or leaves,
few of the other slots change hands. The table depends on the shards alone; it is broadcast, and a key's hash picks a slot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.common import quoted

SHARDS = 64
SLOTS = 6553  # a prime, about a hundred slots per shard
MOST_SLOTS = 1_000_003
HASH_DIGITS = 8


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard of every slot. ``slots`` must be prime, at least the number of shards and at most
    ``MOST_SLOTS``, which bounds what is broadcast; names must differ."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need different names")
    if not len(names) <= slots <= MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    orders = [preference(n, slots) for n in names]
    owner, at, free = [-1] * slots, [0] * len(names), slots
    while free:
        for shard, (offset, skip) in enumerate(orders):
            while owner[slot := (offset + at[shard] * skip) % slots] >= 0:
                at[shard] += 1
            owner[slot] = shard
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as ``slot, shard``."""
    listed = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key by the leading digits of its MD5; a null key is placed like an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint") % slots).cast("int")


def place_on_shards(df: DataFrame, key_col: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` added (columns of these names are replaced).

    Equal keys, null ones too, share a slot, whatever the rest of the row. The join reads a broadcast table of ``slots``
    rows, so rows are placed where they are, without a shuffle.
    """
    table = F.broadcast(table_frame(df.sparkSession, lookup_table(names, slots)))
    rows = df.select(*[quoted(c) for c in df.columns if c not in ("slot", "shard")], slot_of(F.col(quoted(key_col)), slots).alias("slot"))
    return rows.join(table, "slot").select(*[quoted(c) for c in rows.columns], "shard")
