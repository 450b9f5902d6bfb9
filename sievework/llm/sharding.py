"""Sharding by a permutation-filled lookup table (operator 1).

Each shard walks its own permutation of the slots of a prime-sized table; the shards
take turns, each claiming the next slot of its walk that is still free, until the table
is full. A key is hashed to a slot, and one lookup gives its shard. Adding or removing
a shard moves few keys besides those it gains or loses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2053 slots for 16 shards: over 100 slots a shard, so shares differ by under 1 %.
SHARDS, TABLE_SIZE = tuple(f"shard-{i:02d}" for i in range(16)), 2053


def _number(text: str) -> int:
    """First 60 bits of the text's MD5; :func:`slot_of` has the same in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of each slot. Its cost depends on the prime ``size`` alone, not on data.

    Raises ValueError for no shards, repeated names, a size that isn't prime, or fewer
    slots than shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if size < max(2, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime of at least the number of shards")
    walks = [(_number(f"{s}|offset") % size, _number(f"{s}|skip") % (size - 1) + 1) for s in shards]
    table, at, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for i, (offset, skip) in enumerate(walks):
            while table[slot := (offset + at[i] * skip) % size] >= 0:
                at[i] += 1
            table[slot] = i
            filled += 1
            if filled == size:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The filled table as rows ``slot, shard``; it has exactly ``size`` rows."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of each row; no shuffle, rows keep their partitions.

    Equal keys share a shard. A null key counts as the empty string. Repeated rows all
    stay; no rows give no rows. Columns of ``df`` named like the two new ones are
    replaced. The broadcast table has ``size`` rows, however large the data.
    """
    table = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = df.drop(slot_col, shard_col)
    return (
        kept.withColumn("__at", slot_of(F.col(key), size))
        .join(F.broadcast(table), F.col("__at") == F.col("__slot"), "left")
        .select(*kept.columns, F.col("__at").alias(slot_col), F.col("__shard").alias(shard_col))
    )
