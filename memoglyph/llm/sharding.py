"""Placing rows on shards by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own; the shards take turns, and each claims its
most preferred free slot until all are taken. So shards have equal numbers of slots but for one, and when a shard comes
or goes few slots change hands. A row's hash names its slot, and the table, broadcast, names the shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from memoglyph.llm.common import table
from memoglyph.llm.mixing import hash_of

#: Slots of the table (a prime, a hundred times the shards or more) and shards of the registered query.
SLOTS, SHARDS = 65_537, 128


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. Names must differ; slots must be prime and at least as many."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, and at least one")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    draws = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in draws]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in draws]
    out = [-1] * slots
    taken = 0
    while taken < slots:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            out[at[i]] = i
            taken += 1
            if taken == slots:
                break
    return out


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """df with slot (int) and shard (string), without a shuffle of df.

    Rows of equal keys share a shard; a null key counts as the empty text. The broadcast table has `slots` rows, whatever
    the data. Columns of df named slot or shard are replaced; an empty df gives an empty result.
    """
    found = df.sparkSession.createDataFrame(list(enumerate(shards[i] for i in lookup(shards, slots))), "slot int, shard string")
    slot = F.pmod(hash_of(f"`{key}`"), F.lit(slots)).cast("int").alias("slot")
    slotted = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")), slot)
    return slotted.join(F.broadcast(found), "slot")


def write(placed: DataFrame, path: str, splits: int = 16) -> None:
    """Rows of place() as Parquet under path/shard=name, each shard in up to `splits` files so that none is one task's.

    Nulls, empty and long texts are written as they are, equal rows into one file; an empty table writes no file.
    """
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(splits))
    placed.repartition(F.col("shard"), salt).write.partitionBy("shard").mode("overwrite").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents placed on 128 shards: doc_id, slot, shard."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    return place(docs, [f"shard-{i:04d}" for i in range(SHARDS)]).select("doc_id", "slot", "shard")
