"""Sharding by a permutation-filled lookup table: consistent placement in constant time.

Every shard walks the slots of a table of prime size in its own order, given by an offset and a step derived
from its name. The shards take turns; at its turn a shard claims the first slot of its order that is still free.
A key goes to the shard that owns slot ``hash(key) mod size``. Shards own nearly equal numbers of slots, and if
a shard leaves, nearly all other keys stay where they were.

The table is bounded by its size parameter, not by the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 16_381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _draw(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The owner (an index into ``shards``) of each slot. ``size`` is a prime above the number of shards."""
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime above 2, not {size}")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, at least one and at most a table's size")
    at = [_draw(f"offset|{s}") % size for s in shards]
    step = [_draw(f"step|{s}") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first eight hexadecimal digits of its MD5, as a number, modulo the size. A null key counts as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") % size


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard, shard_name)."""
    rows = F.from_json(F.lit(json.dumps(fill_table(shards, size))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return (
        spark.range(1)
        .select(F.posexplode(rows).alias("slot", "shard"))
        .select(F.col("slot").cast("bigint").alias("slot"), "shard", F.element_at(names, F.col("shard") + 1).alias("shard_name"))
    )


def assign_shards(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot, shard and shard_name (replaced if it has such columns).

    Equal keys share a shard, repeated rows are kept, a null key goes where the empty string goes, and an empty
    table gives an empty table. Nothing is shuffled: a hot key costs its own rows only.
    """
    kept = [c for c in df.columns if c not in ("slot", "shard", "shard_name")]
    keyed = df.select(*(F.col(f"`{c}`") for c in kept), slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return keyed.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot", "left").select(*(f"`{c}`" for c in kept), "slot", "shard", "shard_name")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs).select("doc_id", "slot", "shard", "shard_name")


def op9_sql() -> str:
    """The same in SQL; the table's rows are spelled out."""
    owners = ",".join(map(str, fill_table()))
    return f"""
        WITH t AS (SELECT [{owners}] AS owners),
             d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
        SELECT doc_id, slot, owners[slot + 1]::INTEGER AS shard, printf('shard-%03d', owners[slot + 1]) AS shard_name FROM d, t"""
