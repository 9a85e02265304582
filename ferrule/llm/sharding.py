"""Shard placement by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table (an offset and a stride hashed from its name). The shards
take turns, each claiming the first free slot of its permutation, until the table is full: shares differ by one slot at
most, and a shard that leaves gives up its own slots and moves few others. The table is a constant of the plan, shipped to
the executors with the stage, so that a row is placed by one hash and one array access and nothing is shuffled.

Defined results: a null key has a null shard; an empty key is a key like any other; equal keys have equal shards, so repeated
rows stay together; all rows and columns are kept, an existing column named as the output is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16_381  # a prime, some 256 slots for each of 64 shards


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards have distinct names and at least a slot each")
    if any("\n" in s for s in shards):
        raise ValueError("the name of a shard is one line")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is a prime")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "stride") % (slots - 1) + 1 if slots > 1 else 0 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 32 bits of its MD5 modulo the size of the table."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, *, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the name of the shard of each row."""
    names = F.split(F.lit("\n".join(shards[k] for k in lookup_table(shards, slots))), "\n")  # folded to a literal array
    return docs.withColumn(out, F.get(names, slot_of(F.col(key), slots)))
