"""Operator 8: sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table; in turns, each shard claims the next
slot of its order that is free, until the table is full. A row's key is hashed to a slot, and one broadcast join with the
table (its size is the parameter `slots`) places it. Shards hold almost equal numbers of slots, and adding or removing one
moves few keys beyond its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime number of slots; a table of this size is about 1 MB.
SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order; any step visits all slots, their number being prime."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    table, free = [-1] * slots, slots
    at, step = map(list, zip(*(preference(s, slots) for s in shards), strict=True))
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot; a null key has a slot as any other."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    rows = [(i, s, shards[s]) for i, s in enumerate(lookup(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df's column `key` with slot, shard (index) and shard_name for every row.

    Equal keys go to one shard, null keys too; rows are neither merged nor dropped, and an empty table stays empty.
    """
    rows = df.select(F.col(key).alias("key")).withColumn("slot", slot_of(F.col("key").cast("string"), slots))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select("key", "slot", "shard", "shard_name")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 4, slots: int = SLOTS) -> None:
    """Writes all rows of df, one folder `shard=NAME` per shard; if df has a column of that name, the folders' gets underscores before it.

    Each shard is dealt over `files_per_shard` tasks by a hash of the row, so that one hot key does not fill one task.
    """
    folder = "shard"
    while folder in df.columns:
        folder = f"_{folder}"
    names = F.broadcast(table_frame(df.sparkSession, shards, slots).select("slot", F.col("shard_name").alias("name")))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    rows = df.select(F.struct(*df.columns).alias("row"), part.alias("part"), slot_of(F.col(key).cast("string"), slots).alias("slot")).join(names, "slot")
    rows.repartition("name", "part").select("row.*", F.col("name").alias(folder)).write.partitionBy(folder).parquet(path)
