"""Operator 3: sharding by a permutation-filled lookup table, with DataFrame operations only.

Each shard's name gives a permutation of the slots of a table of prime size (an offset and a stride). Shards take turns; each
claims the first slot of its permutation that is still free, until the table is full. So every shard has the same number of
slots, but for one, and a shard that leaves or joins moves little else. A row's slot is a hash of its key modulo the
table's size; its shard is one lookup in the table, which is broadcast: its size is the prime and does not grow with data.

Defined results: a null key is placed as the empty text. Equal keys, repeated rows too, meet in one shard. Columns named
``slot`` or ``shard`` of the input are replaced.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, about a thousand times the number of shards or more.
TABLE_SIZE = 65537


@functools.lru_cache(16)
def lookup_table(shards: tuple[str, ...], size: int = TABLE_SIZE) -> tuple[int, ...]:
    """The shard's position in ``shards`` for each slot."""
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than the table has slots")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    stride = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while True:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + stride[s]) % size
            table[at[s]] = s
            free -= 1
            if not free:
                return tuple(table)


def slot(key: F.Column, size: int = TABLE_SIZE) -> F.Column:
    """60 bits of the key's MD5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` plus ``slot`` and ``shard``, the name of the row's shard."""
    table = lookup_table(tuple(shards), size)
    spark = df.sparkSession
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "n"))
    names = F.array(*map(F.lit, shards))
    slots = slots.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot(F.col(key), size).alias("slot")).join(F.broadcast(slots), "slot").select(*kept, "slot", "shard")


def oracle(table: str, key: str, shards: list[str], size: int = TABLE_SIZE) -> str:
    """DuckDB SQL for ``place(...)`` of one key column."""
    slots = ",".join(map(str, lookup_table(tuple(shards), size)))
    names = ", ".join(f"'{s}'" for s in shards)
    return (
        f"WITH slots AS (SELECT string_split('{slots}', ',') AS claimed), names AS (SELECT [{names}] AS name), "
        f"placed AS (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM {table}) "
        f"SELECT {key}, slot, name[claimed[slot + 1]::BIGINT + 1] AS shard FROM placed, slots, names"
    )
