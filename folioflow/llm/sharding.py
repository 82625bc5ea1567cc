"""Sharding by a permutation-filled lookup table.

Each shard derives a permutation of the slots of a prime-sized table from its name (an offset and a
stride). The shards take turns; in its turn a shard claims the first free slot of its permutation. The
finished table goes to every executor once, and a key's hash modulo its size names the slot. Adding or
removing a shard moves few keys between the others, and every shard owns nearly the same number of slots.

The table's size is a parameter, so what is broadcast does not grow with the rows. A key that holds a
third of all rows would still fill one shard: pass a second column to `spread` such keys.

Defined results: a null key hashes as the empty string; repeated keys go to one shard; further columns
of the input stay, but slot and shard replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

SLOTS, SHARDS = 4099, 32
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in `shards` that owns each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not len(shards) <= slots <= MAX_SLOTS or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    offset = [_number(f"{s}/offset") % slots for s in shards]
    stride = [_number(f"{s}/stride") % (slots - 1) + 1 for s in shards]
    turn, owner, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + turn[i] * stride[i]) % slots] >= 0:
                turn[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, spread: str | None = None) -> DataFrame:
    """df with slot and shard. One broadcast join, no shuffle."""
    spark = df.sparkSession
    owner = lookup_table(shards, slots)
    placed = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "slot int, shard string")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread:
        k = F.concat_ws("|", k, F.coalesce(F.col(spread).cast("string"), F.lit("")))
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(k, slots))
    return keyed.join(F.broadcast(placed), "slot")


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder for each shard; several tasks write one shard, so a large shard is not one task."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "shard"][:1]), F.lit(files_per_shard))
    df.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


def op2_sql() -> str:
    """The finished table is data to SQL; the hash and the lookup are what it restates."""
    names, owner = shard_names(), lookup_table(shard_names())
    listed = ", ".join(map(str, owner))
    return f"""
        SELECT doc_id, slot, 'shard-' || lpad(CAST(([{listed}])[slot + 1] AS VARCHAR), 3, '0') AS shard
        FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
    """ if len(names) <= 1000 else ""
