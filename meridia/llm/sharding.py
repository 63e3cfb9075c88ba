"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a
skip derived from its name). Shards take turns, each claiming the next free slot of its
preference order, until the table is full; shards with a weight take that many turns a
round. A document's slot is a hash of its key modulo the table size, so placement is one
look-up in a small broadcast table. Removing a shard moves few of the other shards' keys.

Edge cases: a null key hashes as the empty string; equal keys share a shard; an empty
table gives no rows; the input's own columns named ``shard`` or ``slot`` are replaced.
The rows placed carry only their key, so one hot key costs no more than any other row
(no shuffle takes place at all).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_SIZE = 4099  # a prime, over 100 slots a shard at 32 shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Shard number of each slot. The work depends on the configuration only, not on data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, no smaller than the number of shards")

    def number(name: str, salt: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")

    start = [number(s, "offset") % size for s in shards]
    skip = [number(s, "skip") % (size - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    step, owner, free = [0] * len(shards), [-1] * size, size
    while free:
        for k in range(len(shards)):
            for _ in range(turns[k]):
                if not free:
                    return owner
                while owner[slot := (start[k] + step[k] * skip[k]) % size] >= 0:
                    step[k] += 1
                owner[slot] = k
                step[k] += 1
                free -= 1
    return owner


def lookup_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as a (slot, shard) frame, built from one literal."""
    listed = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(key, size: int = TABLE_SIZE):
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (int). The broadcast table has ``size`` rows."""
    owner = fill_table(shards, size, weights)
    kept = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return kept.join(F.broadcast(lookup_frame(docs.sparkSession, owner)), "slot", "left").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write each shard to its own folder ``shard=N``; tasks write what they hold, nothing is gathered."""
    assign_shards(docs, **options).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    placed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return assign_shards(placed).select("doc_id", "slot", "shard", "n_bytes")


def oracle() -> str:
    owner = ",".join(map(str, fill_table()))
    return f"""
    WITH lookup AS (SELECT unnest(range({TABLE_SIZE})) AS slot, CAST(unnest(string_split('{owner}', ',')) AS INTEGER) AS shard),
    placed AS (
      SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
             CAST(('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % {TABLE_SIZE} AS INTEGER) AS slot
      FROM documents)
    SELECT doc_id, slot, shard, n_bytes FROM placed JOIN lookup USING (slot)"""
