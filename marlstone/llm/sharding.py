"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size
(an offset and a stride from two hashes of its name). Shards take turns: each
claims the next slot of its permutation that is free, until none is. All
shards get the same number of slots, give or take one, and when a shard joins or
leaves few slots change hands. A row's slot is a hash of its key, so placement is
one look-up in a broadcast table whose size the caller fixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table's size: a prime, well over a hundred times the shards.
SLOTS = 65_537
#: The broadcast's bound: a table has no more slots than this.
MOST_SLOTS = 2_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt).digest(), "big")


def table_of(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that holds each slot."""
    if not _prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the number of slots must be a prime of at most {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one, at most one a slot")
    at = [_number(s, b"offset") % slots for s in shards]
    step = [_number(s, b"stride") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    left = slots
    while True:
        for k in range(len(at)):
            slot = at[k]
            while held[slot] >= 0:
                slot = (slot + step[k]) % slots
            held[slot] = k
            at[k] = (slot + step[k]) % slots
            left -= 1
            if not left:
                return np.array(held, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot; a null key has slot 0 of its own hash like any other value."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no shuffle.

    Rows with equal keys (repeated rows, null keys, which count as empty
    strings) share a shard, however long the key is; no rows give no rows.
    Other columns stay, whatever their names; columns called ``slot`` and ``shard``,
    the key too, are replaced.
    """
    held = table_of(shards, slots)
    lookup = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(held.tolist())], "slot int, shard string")
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("__none")).alias("row")  # no name clashes in the join
    placed = df.select(row, slot_of(F.col(f"`{key}`"), slots).alias("slot")).join(F.broadcast(lookup), "slot")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in rest), "slot", "shard")
