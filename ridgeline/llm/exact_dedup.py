"""Exact dedup by two passes over a Bloom filter; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import fold_ascii
from ridgeline.operators.tables import join_hot, materialize

#: Bits of one filter block: what Spark's bitmap functions hold in 4 KB.
BLOCK_BITS = 32768


def _bit(bits: Column, position: Column) -> Column:
    """Bit ``position`` of a bitmap as ``bitmap_construct_agg`` lays it out."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def repeated_filter(hashed: DataFrame) -> DataFrame:
    """First pass: a blocked Bloom filter whose bits are set only where two rows or more fall, 4 KB a block.

    Only (block, bit) counts shuffle, combined before they do, so a hash that a third of all rows share costs one entry a task.
    """
    slots = hashed.select("block", F.explode(F.array_distinct(F.array("bit1", "bit2"))).alias("bit"))
    twice = slots.groupBy("block", "bit").count().filter("count >= 2")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. Pass one sets
    a Bloom bit where two hashes or more fall; in pass two a row whose two bits are not both set is unique and passes
    straight through, and only the others are grouped, by all 256 bits of the digest. The filter takes ``bits_per_row``
    for each row; up to ``max_filter_bytes`` it is broadcast, beyond that its blocks are joined by a shuffle of hashes.

    Null text counts as empty, and empty texts equal each other. A null id ranks below all ids; of repeated rows with the
    same id and text exactly one stays. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    digest = F.sha2(fold_ascii(F.col(text_col)).cast("binary"), 256)
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "dedup-hashes")
    count = rows.count()
    blocks = max(1, -(-count * bits_per_row // BLOCK_BITS))
    h = F.xxhash64("text_sha256")
    hashed = rows.select(
        "*",
        F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(blocks)).alias("block"),
        F.pmod(h, F.lit(BLOCK_BITS)).alias("bit1"),
        F.pmod(F.shiftrightunsigned(h, 24), F.lit(BLOCK_BITS)).alias("bit2"),
    )
    bits = repeated_filter(hashed)
    tested = hashed.join(F.broadcast(bits) if blocks * BLOCK_BITS // 8 <= max_filter_bytes else bits, "block", "left")
    tested = tested.withColumn("maybe", F.coalesce(_bit(F.col("bits"), F.col("bit1")) & _bit(F.col("bits"), F.col("bit2")), F.lit(False))).select("doc_id", "text_sha256", "row", "maybe")
    single = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("maybe").drop("maybe")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    joined = join_hot(maybe, groups, "text_sha256", count)
    return single.unionByName(joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
