"""Placement of rows on shards through a permutation-filled lookup table of prime size.

The table is a constant of (shard names, table size): it is filled once, before any row is read, and is at most a few
thousand entries. Rows are placed by DataFrame functions alone: hash of the key, modulo the table size, one lookup in a
broadcast table. No row is shuffled, so a hot key or source costs nothing beyond its own rows.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: At least a hundred slots for each shard keeps shares within about one per cent of each other.
SLOTS_PER_SHARD = 100


def prime_above(n: int) -> int:
    while n < 2 or any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def lookup_table(shards: list[str], size: int | None = None) -> list[int]:
    """slot -> place of the shard that owns it.

    Each shard prefers slots in the order (offset + j * skip) mod size, from two hashes of its name; as size is prime
    that is a permutation. Shards take turns, each claiming its most preferred free slot, until none is free: shares
    differ by one slot at most, and losing a shard moves few slots besides its own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    size = size or prime_above(len(shards) * SLOTS_PER_SHARD)
    if size < len(shards) or prime_above(size) != size:
        raise ValueError("the table size must be a prime, no smaller than the number of shards")
    seeds = [md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(s[:8], "big") % size for s in seeds]
    skip = [int.from_bytes(s[8:], "big") % (size - 1) + 1 for s in seeds]
    owner, free, k = [-1] * size, size, 0
    while free:
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % size
        owner[at[k]] = k
        free -= 1
        k = (k + 1) % len(shards)
    return owner


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int | None = None) -> DataFrame:
    """df with slot (long) and shard (string).

    The hash is the first 60 bits of the MD5 of the key as text, so any engine can repeat it. A null key counts as the
    empty string; equal keys get equal shards; an empty table stays empty. Columns of df named slot or shard are replaced.
    """
    shards = SHARDS if shards is None else shards
    owners = lookup_table(shards, size)
    spark = df.sparkSession
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % len(owners)
    names = F.split(F.lit(",".join(str(k) for k in owners)), ",")
    named = F.split(F.lit("\n".join(shards)), "\n")
    slots = spark.range(len(owners)).select(F.col("id").alias("slot"), F.element_at(names, F.col("id").cast("int") + 1).cast("int").alias("__k"))
    slots = slots.select("slot", F.element_at(named, F.col("__k") + 1).alias("shard"))
    # its size is that of the table, a parameter, whatever the rows
    return df.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(slots), "slot")


def shard_sizes(placed: DataFrame) -> DataFrame:
    """Rows of each shard (pre-aggregated, one row a shard)."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; every task writes its own files, so a large shard is written by many tasks."""
    placed.write.partitionBy("shard").mode("overwrite").parquet(path)
