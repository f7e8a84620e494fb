"""Placement of rows on shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step from its name).
Shards take turns, each claiming its next preferred slot that is free, until the table is full. A row's key is
hashed to a slot and the slot names the shard: one lookup in a table that is broadcast (its size is a parameter and
does not grow with the data). Shards get equal numbers of slots but for one, or as many turns a round as their weight,
and when a shard leaves, few slots of the others change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099   # prime; at least 100 slots a shard keep loads within about one percent


def number(text: str, start: int) -> int:
    """Thirty-two bits of a name's digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[start:start + 8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** .5) + 1))


def filled_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Index of the shard that owns each slot. Shards with weight w take w turns a round.

    The fill is a sequence of turns over a table of fixed size; no row of data is involved.
    """
    if not is_prime(slots) or not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("a prime number of slots, and distinct shards, at most one a slot, are needed")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("one weight a shard, not all of them zero")
    at = [number(s, 0) % slots for s in shards]
    step = [number(s, 8) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard) with one row a slot, from a literal that the JVM reads."""
    text = ",".join(map(str, filled_table(shards, slots, weights)))
    names = F.array(*[F.lit(s) for s in shards])
    listed = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "own"))
    return listed.select("slot", F.get(names, F.col("own").cast("int")).alias("shard"))


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its parts as text, modulo the number of slots. Null parts differ from empty ones."""
    parts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(rows: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """Adds `slot` and `shard` to every row, without a shuffle: equal keys (nulls too) go to one shard.

    Existing columns of these names are replaced. An empty table stays empty.
    """
    table = lookup_table(rows.sparkSession, shards, slots, weights)
    placed = rows.drop("slot", "shard").withColumn("slot", slot_of([F.col(f"`{k}`") for k in keys], slots))
    return placed.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def loads(placed: DataFrame, weight: Column | None = None) -> DataFrame:
    """(shard, n_rows, weight): what each shard holds; `weight` is, say, the length of the text."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.lit(1) if weight is None else weight).alias("weight"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 16) -> None:
    """Writes one folder a shard. A shard's rows are spread over several tasks, so a large shard is not one file."""
    spread = placed.withColumn("_part", F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard)))
    spread.repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)
