"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size (an
offset and a step, from its name); the shards take turns, and each claims the
first slot of its permutation that is still free.  Shards then differ by one
slot at most, and when a shard goes, few slots of the others move.  The table
has a fixed size and is broadcast, so a document is placed by one hash and one
lookup, without a shuffle.

DataFrame operations only.  Defined results: a null id has a fixed slot of its
own; equal ids have equal places; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime far above the number of shards.
SLOTS = 65_537


def _hash(name: str, salt: str) -> int:
    return zlib.crc32(f"{salt}/{name}".encode()) << 32 | zlib.crc32(f"{name}/{salt}".encode())


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards] if slots > 2 else [1] * len(shards)
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard`` (overwritten if there)."""
    spark = docs.sparkSession
    packed = ",".join(map(str, lookup_table(shards, slots)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("_slot", "_k"))
    names = F.array(*[F.lit(s) for s in shards])
    rows = rows.select("_slot", F.element_at(names, F.col("_k").cast("int") + 1).alias("shard"))
    keep = docs.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int"))
    return keep.join(F.broadcast(rows), F.col("slot") == F.col("_slot"), "inner").drop("_slot")  # ``slots`` rows, a fixed number
