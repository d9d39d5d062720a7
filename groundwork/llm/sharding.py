"""Sharding: a lookup table that shards fill in turn by preference order.

Each shard has its own permutation of the slots of a table whose size is prime. In
turn, every shard claims the next free slot of its permutation until none is free, so
shards get equal shares (within one slot) and few slots move when a shard comes or
goes. Placing a row is one hash and one look into a broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of a table, at most; what is broadcast is bounded by it.
MOST_SLOTS = 1_000_003


def prime_from(n: int) -> int:
    """The least prime that is not below ``n``."""
    n = max(n, 2)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and stride of a shard's permutation."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:12], 16) % slots, int(digest[12:24], 16) % (slots - 1) + 1 if slots > 2 else 1


def lookup_table(shards: list[str], slots: int) -> list[str]:
    """The shard of each slot. ``slots`` is prime; shard names are distinct."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots < len(shards) or slots > MOST_SLOTS or prime_from(slots) != slots:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    ways = [preference(s, slots) for s in shards]
    tried, owner, left = [0] * len(shards), [""] * slots, slots
    while left:
        for k, (first, stride) in enumerate(ways):
            while owner[slot := (first + tried[k] * stride) % slots]:
                tried[k] += 1
            owner[slot] = shards[k]
            tried[k] += 1
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of its text's MD5, modulo the slots. Null has a slot of its own text."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key: str, shards: list[str], slots: int | None = None) -> DataFrame:
    """``docs`` with ``slot`` (long) and ``shard`` (string) by the column ``key``.

    Rows with equal keys, repeated rows and null keys each go to one shard; an empty
    table gives an empty table. Columns named slot or shard are replaced. No shuffle:
    the table of ``slots`` rows (checked against MOST_SLOTS) is broadcast.
    """
    slots = slots or prime_from(100 * len(shards))
    owner = lookup_table(shards, slots)
    if any("," in s for s in shards):
        raise ValueError("shard names must have no comma")
    filled = _slots(docs.sparkSession, owner)
    placed = docs.drop("slot", "shard").withColumn("slot", slot_of(docs[key], slots))
    return placed.join(F.broadcast(filled), F.col("slot") == F.col("__slot")).withColumnRenamed("__shard", "shard").drop("__slot")


def _slots(spark: SparkSession, owner: list[str]) -> DataFrame:
    listed = F.posexplode(F.split(F.lit(",".join(owner)), ",")).alias("__slot", "__shard")
    return spark.range(1).select(listed).select(F.col("__slot").cast("long").alias("__slot"), "__shard")
