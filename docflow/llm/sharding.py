"""Sharding by a permutation-filled lookup table (operator 10).

Each shard has a permutation of the slots of a prime-sized table (offset + k * skip mod size, both hashes of its
name); shards take turns, each claiming its next free slot, until the table is full. A key's slot is a hash of it, so that
placement is one lookup; a change of the shards moves few keys beyond those that must.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, far above the number of shards: shares differ by about shards / TABLE.
TABLE = 65537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be some distinct names, no more than slots")
    at = [_number("offset:" + s) % size for s in shards]
    skip = [_number("skip:" + s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for s in range(len(shards)):
            c = at[s]
            while table[c] >= 0:
                c = (c + skip[s]) % size
            table[c] = s
            at[s] = (c + skip[s]) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key, size: int = TABLE):
    """Slot of a key column: the first 52 bits of the md5 of its string, modulo size. Null is the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str], *, key_col: str = "doc_id", size: int = TABLE, shard_col: str = "shard") -> DataFrame:
    """docs with the name of each row's shard in shard_col (a column of that name is replaced; other names can't clash).

    Equal keys have one shard; null keys that of the empty string; no shuffle: the table, of `size` rows whatever the
    data, is broadcast. An empty table gives an empty table."""
    table = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill_table(shards, size))], "__slot int, __shard string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), slot_of(F.col(key_col), size).alias("__slot"))
    kept = [c for c in docs.columns if c != shard_col]
    return whole.join(F.broadcast(table), "__slot").select(*[F.col("__row").getField(c).alias(c) for c in kept], F.col("__shard").alias(shard_col))
