"""Sharding by a permutation-filled lookup table; DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; the table holds so many slots, 65,537 small integers, whatever the data's size.
TABLE_SIZE = 65_537


def _number(name: str, salt: bytes) -> int:
    return int.from_bytes(blake2b(name.encode(), digest_size=8, salt=salt).digest(), "little")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard.

    Each shard prefers the slots offset, offset + skip, offset + 2 * skip, ... modulo the prime ``size``, a permutation of
    all slots; shards take turns, each claiming the first free slot of its order. So shares differ by one slot at most,
    and when a shard goes or comes, few other slots change hands.
    """
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    if any("\n" in s for s in shards):
        raise ValueError("a shard's name has no line end")
    at = [_number(s, b"offset") % size for s in shards]
    skip = [_number(s, b"skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard, shard_name), built in the JVM from one literal."""
    literal = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    rows = spark.range(1).select(F.posexplode(literal).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return rows.withColumn("shard_name", F.element_at(names, F.col("shard") + 1))


def assign_shards(docs: DataFrame, shards: Sequence[str], size: int = TABLE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, slot, shard, shard_name, n_bytes (of the text in UTF-8).

    The slot is the id's hash modulo the table's size, the shard a lookup in the broadcast table: no shuffle, and the
    place of a document depends on nothing but its id. Documents with a null id are placed by their text, so they don't
    all meet in one shard; null text has no bytes. Repeated rows share a shard. Empty tables give no rows. Since ids are
    hashed, no hot source or group of copies can fill one shard.
    """
    key = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.pmod(key, F.lit(size)).cast("int").alias("slot"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, shards, size)), "slot").select("doc_id", "slot", "shard", "shard_name", "n_bytes")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], size: int = TABLE_SIZE, files_per_shard: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as Parquet, one folder ``shard_name=...`` a shard and ``files_per_shard`` files in each.

    The folder's name takes the place of a column ``shard_name`` of ``docs``; all other columns are kept, whatever their names.
    """
    key = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    slot = F.pmod(key, F.lit(size)).cast("int")
    own = f"slot_{uuid.uuid4().hex}"
    table = table_frame(docs.sparkSession, shards, size).select(F.col("slot").alias(own), "shard_name")
    salt = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(files_per_shard))
    placed = docs.withColumn(own, slot).drop("shard_name").join(F.broadcast(table), own).drop(own)
    placed.repartition(len(shards) * files_per_shard, "shard_name", salt).write.partitionBy("shard_name").parquet(path)
