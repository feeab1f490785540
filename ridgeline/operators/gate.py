"""The admission gate: running relationship counts decide which alerts are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import scalars as S


def relationship_key(source: Column, target: Column, kind: Column, action: Column) -> Column:
    """source|target|kind|action; a missing target is a dash."""
    return F.concat_ws("|", source, F.coalesce(target, F.lit("-")), F.lower(kind), F.lower(action))


def edge_key(source: Column, target: Column, tactic: Column, *details: Column) -> Column:
    """source|target|tactic|first detail that is not blank, else observed; lower-cased (WIN-02)."""
    return F.lower(F.concat_ws("|", *[F.trim(c) for c in (source, target, tactic)], S.first_text(*details, default="observed")))


def seen_before(key: str | list[str], order: list[str]) -> Column:
    """How often the key came before this row (WIN-01). ``order`` must end in a unique column."""
    return (F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)) - 1).cast("long")


def with_baseline(df: DataFrame, baseline: DataFrame | None, key: str = "rel_key") -> DataFrame:
    """Adds counts known beforehand (rel_key, seeded) to ``seen`` (FLT-03, AUX-19)."""
    if baseline is None:
        return df
    return df.join(baseline, key, "left").withColumn("seen", F.col("seen") + F.coalesce("seeded", F.lit(0))).drop("seeded")


def decide(severity: Column, seen: Column, attack: Column, too_common: int = 10_000, rare: int = 3, rare_severity: int = 5) -> Column:
    """Reason of the gate's decision, by the first rule that holds (FLT-01)."""
    return (
        F.when(severity >= 8, "high_severity")
        .when(seen > too_common, "baseline_too_common")
        .when(attack, "attack_topology")
        .when((seen <= rare) & (severity >= rare_severity), "rare_relationship")
        .otherwise("not_interesting")
    )


def stored(reason: Column) -> Column:
    return reason.isin("high_severity", "attack_topology", "rare_relationship")


def gate(alerts: DataFrame, key: str, order: list[str], attack: Column, baseline: DataFrame | None = None, **limits) -> DataFrame:
    """``alerts`` with seen, reason and store. One shuffle, on the relationship key, in which rows are sorted and counted."""
    counted = with_baseline(alerts.withColumn("seen", seen_before(key, order)), baseline, key)
    decided = counted.withColumn("reason", decide(F.col("severity"), F.col("seen"), attack, **limits))
    return decided.withColumn("store", stored(F.col("reason")))


def first_or_stored(decisions: DataFrame, order: list[str], id_col: str = "alert_id") -> DataFrame:
    """One decision an id: the first, unless a later one stores (FLT-04)."""
    rank = F.struct(~F.col("store"), *[F.col(c) for c in order])
    picked = F.min_by(F.struct("store", "reason", "seen"), rank).alias("d")
    return decisions.groupBy(id_col).agg(picked).select(id_col, "d.*")


def last_decision(decisions: DataFrame, order: list[str], id_col: str = "alert_id") -> DataFrame:
    """One decision an id: the last (FLT-05)."""
    return decisions.groupBy(id_col).agg(F.max_by(F.struct("store", "reason", "seen"), F.struct(*order)).alias("d")).select(id_col, "d.*")


def sketch_counts(df: DataFrame, key: str, eps: float = 1e-4, confidence: float = 0.96875, seed: int = 7) -> DataFrame:
    """A count-min sketch of the key's frequencies, 20,000 by 5 at the defaults (AGG-01): one small binary, merged from partial ones."""
    return df.agg(F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def sketch_estimates(df: DataFrame, key: str, width: int = 20_000, depth: int = 5) -> DataFrame:
    """(key, count, estimate): what a count-min sketch of ``depth`` rows of ``width`` counters says of every key, never under its count (AGG-01).

    Counters are rows (row, cell), summed from counts by key; an estimate is the least of a key's counters. Cells come from
    MD5, so any engine fills the same sketch.
    """
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    at = lambda d: F.conv(F.substring(F.md5(F.concat(F.lit(f"{d}:"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long") % width
    cells = n.select(key, "count", F.posexplode(F.array(*map(at, range(depth)))).alias("row", "cell"))
    counters = cells.groupBy("row", "cell").agg(F.sum("count").alias("counter"))
    return cells.join(counters, ["row", "cell"]).groupBy(key).agg(F.first("count").alias("count"), F.min("counter").alias("estimate"))


def processing_stats(decisions: DataFrame, seconds: float | None = None) -> DataFrame:
    """processed, stored, stored_ratio, and alerts_per_second if the time is known (STR-03, AUX-48)."""
    n, s = F.count(F.lit(1)), F.count_if("store")
    rate = F.lit(None).cast("double") if seconds is None else F.lit(float("inf")) if seconds == 0 else n / F.lit(seconds)
    return decisions.agg(n.alias("processed"), s.alias("stored"), F.coalesce(F.try_divide(s, n), F.lit(0.0)).alias("stored_ratio"), rate.alias("alerts_per_second"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row of each key (SNK-06, 07): a running maximum by struct, combined before the shuffle."""
    both = current.unionByName(changes)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("row")).select(key, *[F.col(f"row.{c}") for c in cols])
