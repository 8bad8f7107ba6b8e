"""Placement by a permutation-filled lookup table.

The table has a prime number of slots. Each shard prefers the slots in an order of its own: it starts
at a slot that its name's hash gives and goes on by a step that a second hash gives. Shards take
turns, each claiming the first slot of its order that is free, until none is. So shards hold equal shares to
within one slot, and a shard that comes or goes moves little else. The table has ``SLOTS`` rows whatever
the data, so it is broadcast; a key is placed by one look-up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
FREE = -1


def _hash(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be different names, at least one and no more than slots")
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime above 2")
    # In order of their names, so that the order they are given in plays no part.
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _hash(shards[i], "first") % slots for i in order}
    step = {i: _hash(shards[i], "step") % (slots - 1) + 1 for i in order}
    held, left = [FREE] * slots, slots
    while left:
        for i in order[:left]:
            while held[at[i]] != FREE:
                at[i] = (at[i] + step[i]) % slots
            held[at[i]] = i
            left -= 1
    return held


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from 60 bits of the MD5 of its text; a null key is placed as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row per slot."""
    rows = [(slot, shards[i]) for slot, i in enumerate(table(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard string")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard``. No shuffle: the table is broadcast, having ``slots`` rows always.

    Equal keys go to one shard, repeated rows too. Columns of these two names are replaced.
    """
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot").select(
        *[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 4, tasks: int | None = None) -> None:
    """Write one folder per shard; a shard is dealt to ``files`` files by a salt, so that none is one task's work."""
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(*placed.columns), F.lit(files)))
    by = ("shard", "_salt")
    dealt = salted.repartition(tasks, *by) if tasks else salted.repartition(*by)
    dealt.drop("_salt").write.partitionBy("shard").parquet(path)
