"""Mixing sources to target weights by nested hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.tables import few, materialize

WORD = r"[^\x20\x09-\x0D]+"


def unit_hash(column: Column, bits: int) -> Column:
    """The leading ``bits`` (32 at most) of the MD5 of the value as text; null is hashed as an empty text."""
    head = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftrightunsigned(F.conv(head, 16, 10).cast("long"), 32 - bits)


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """Adds the column target to (source, source_size): shares by weight, capped at ``max_repeat`` sizes, the excess reshared.

    Sources in code-point order, null last, take ``weights`` in turn. With the sources sorted by cap over weight, those
    under the water level are a prefix, so the reshared level comes from two running sums instead of a loop.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    w = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_repeat)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("capped", F.col("cap") * F.col("rest") < F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("rank_by_cap", "left", "rest"))).over(everything)
    w = w.withColumn("rank_by_cap", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "rank"))).withColumn("level", level)
    reached = F.col("level").isNull() | (F.col("rank_by_cap") < F.col("level.rank_by_cap"))
    target = F.when(reached, F.col("cap").cast("double")).otherwise(F.col("level.left").cast("double") * F.col("weight") / F.col("level.rest"))
    return w.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, bits: int = 10, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents (doc_id, source, size, hash), and for each source how often it repeats and where its threshold lies.

    The threshold comes from histograms of words by source and hash bucket, combined before they shuffle: level one sums
    2**``bits`` buckets, each further level only the rows of the one boundary bucket of each source.
    """
    if bits * levels > 32:
        raise ValueError("bits * levels must be 32 at most")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), unit_hash(F.col("doc_id"), bits * levels).alias("hash")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(totals, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.withColumn("edge", F.lit(0).cast("long")), "mix-sources")
    small = few(sources)
    side = lambda df: F.broadcast(df) if small else df
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        inside = same & (F.shiftright(F.col("r.hash"), shift + bits) == F.col("s.edge"))
        bucket = F.shiftright(F.col("r.hash"), shift)
        mass = rows.alias("r").join(side(sources.filter("need > 0").alias("s")), inside).groupBy(F.col("r.source").alias("source"), bucket.alias("bucket")).agg(F.sum("size").alias("mass"))
        upto = mass.withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("bucket")))
        # the boundary: the first bucket with which the running sum reaches what is needed
        found = upto.alias("r").join(side(sources.alias("s")), same).filter("upto >= need").groupBy(F.col("r.source").alias("source")).agg(F.min(F.struct("bucket", "r.mass", "upto")).alias("at"))
        s = sources.alias("r").join(side(found.alias("s")), same, "left")
        sources = materialize(
            s.select(
                F.col("r.source").alias("source"), "source_size", "target", "whole",
                F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("at.upto") - F.col("at.mass"))).alias("need"),
                F.coalesce(F.col("at.bucket"), F.lit(-1) if level == levels else F.shiftleft(F.col("edge"), bits)).alias("edge"),
                F.coalesce(F.col("at.mass"), F.lit(0)).alias("mass"),
            ),
            f"mix-level{level}",
        )
    more = F.when(F.col("need") * 2 >= F.col("mass"), F.col("edge")).otherwise(F.col("edge") - 1)
    return rows, sources.select("source", "source_size", "target", "whole", more.alias("upto_hash"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source and hash) joined with their source's plan, and the column copies."""
    joined = rows.alias("r").join(F.broadcast(plan.alias("s")) if few(plan) else plan.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    copies = (F.col("s.whole") + F.when(F.col("r.hash") <= F.col("s.upto_hash"), 1).otherwise(0)).cast("int")
    return joined.select("r.*", "s.source_size", "s.target", copies.alias("copies"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, bits: int = 10, levels: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies.

    A source whose target is k sizes and a remainder repeats every document k times and takes one more copy of the
    documents under a hash threshold (see ``mix_plan``). After ``levels`` the last bucket, whose rows share
    ``bits * levels`` hash bits, is taken if that ends nearer to the target. No rows are sorted, and the hash depends on
    doc_id alone, so reruns agree.

    Null text has size 0; null is a source of its own, the last. Repeated rows share a hash and are taken together; a
    null doc_id is hashed as an empty text. A source of size 0 has target 0. Empty tables give no rows. Other columns
    are not read.
    """
    rows, plan = mix_plan(docs, weights, max_repeat, bits, levels)
    return with_copies(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, bits: int = 10, levels: int = 3) -> DataFrame:
    """``docs`` as mixed: every document as often as ``mix_sources`` takes it, with its own columns. Texts don't shuffle."""
    _, plan = mix_plan(docs, weights, max_repeat, bits, levels)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("source").cast("string").alias("source"), unit_hash(F.col("doc_id"), bits * levels).alias("hash"))
    copied = with_copies(keyed, plan).filter("copies > 0")
    return copied.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) // 4 AS BIGINT) AS h FROM documents),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS rc,
        sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
l AS (SELECT min(rc) AS rc, arg_min(lft, rc) AS lft, arg_min(rest, rc) AS rest FROM o WHERE cap * rest >= lft * w),
t AS (SELECT o.source, source_size, CASE WHEN l.rc IS NULL OR o.rc < l.rc THEN CAST(cap AS DOUBLE) ELSE CAST(l.lft AS DOUBLE) * w / CAST(l.rest AS DOUBLE) END AS target FROM o, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT source, h, sum(size) AS mass, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
e AS (SELECT b.source, min(h) AS edge, arg_min(mass, h) AS mass, arg_min(upto, h) AS upto FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
      WHERE target - whole * source_size > 0 AND upto >= target - whole * source_size GROUP BY b.source)
SELECT d.doc_id, d.size, k.source_size, k.target,
       CAST(d.size * (k.whole + CASE WHEN d.h < e.edge OR (d.h = e.edge AND (k.target - k.whole * k.source_size - (e.upto - e.mass)) * 2 >= e.mass) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(k.whole + CASE WHEN d.h < e.edge OR (d.h = e.edge AND (k.target - k.whole * k.source_size - (e.upto - e.mass)) * 2 >= e.mass) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
