"""Scores of clusters as arithmetic over their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.scalars import best_chain


def _cut(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def validation_confidence(severity: Column, critical: Column, alerts: Column, entities: Column) -> Column:
    """Confidence of a neighbourhood (AGG-06); ``critical``: it has lateral movement, privilege escalation or exfiltration."""
    return _cut(F.lit(0.15) + severity / 10 * 0.4 + F.when(critical, 0.2).otherwise(0.0) + F.least(alerts - 1, F.lit(5)) * 0.05 + F.least(entities, F.lit(5)) * 0.02)


def discovery_score(max_severity: Column, n_score_tags: Column, n: Column, shared: Column, n_kinds: Column, low_frequency: Column, graph_score: Column) -> Column:
    """Score of a discovered cluster (AGG-02)."""
    chain = F.when(n >= 2, 0.30).otherwise(0.0) + F.when(shared > 0, 0.25).otherwise(0.0) + F.when(n_score_tags >= 2, 0.25).otherwise(0.0) + F.when(n_kinds >= 2, 0.20).otherwise(0.0)
    base = max_severity / 10 * 0.30 + _cut(n_score_tags / 3) * 0.25 + _cut(chain) * 0.20 + low_frequency / n * 0.15 + _cut(n / 5) * 0.10
    return _cut(base + graph_score * 0.10)


def structural_score(max_severity: Column, high: Column, n: Column, hosts: Column, tactics: Column, duration_s: Column, matches: Column, rare: Column | None = None) -> Column:
    """Structural score of an incident, with rarity if ``rare`` rows are counted (AGG-03)."""
    temporal = F.lit(1.0) - F.least(F.greatest(duration_s, F.lit(1.0)), F.lit(21600.0)) / 21600.0
    terms = [max_severity / 10, high / n, _cut(n / 8), _cut(hosts / 3), _cut(tactics / 4), temporal, _cut(matches / 2)]
    weights = [0.25, 0.20, 0.15, 0.10, 0.10, 0.10, 0.10] if rare is None else [0.22, 0.18, 0.14, 0.10, 0.10, 0.09, 0.10]
    total = F.lit(0.0)
    for t, w in zip(terms, weights, strict=True):
        total = total + t * w
    return F.round(_cut(total if rare is None else total + rare / n * 0.07), 6)


def verdict_score(structural: Column, n: Column, tactics: Column, patterns: Column, order: Column, high: Column, rare: Column) -> Column:
    """Evidence for an incident (AGG-05); it is selected from 0.68 on, and the confidence is the score or what it lacks to 1."""
    e = structural * 0.26 + _cut(n / 10) * 0.16 + _cut(tactics / 6) * 0.16 + _cut(patterns / 4) * 0.16 + order * 0.16 + high / n * 0.05 + rare / n * 0.05
    return F.greatest(F.lit(0.0), _cut(e))


def with_verdict(df: DataFrame, score: Column, threshold: float = 0.68) -> DataFrame:
    chosen = score >= threshold
    return df.withColumn("evidence", score).withColumn("selected", chosen).withColumn("confidence", F.when(chosen, score).otherwise(1 - score))


def cluster_facts(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Counts that the scores need, one row a cluster, combined before the shuffle (AGG-04, 10, 19..21)."""
    return rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("severity").alias("max_severity"),
        F.count_if(F.col("severity") >= 8).alias("high"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.countDistinct(F.when(F.trim("tactic") != "", F.col("tactic"))).alias("tactics"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration_s"),
    )


def order_score(sequence: Column) -> Column:
    return best_chain(sequence)


def continuity(n: Column, most_shared: Column) -> Column:
    """Whether one entity runs through enough of the cluster (FLT-14)."""
    m = F.coalesce(most_shared, F.lit(0))
    return F.when(n <= 3, m >= 2).when(n <= 10, m >= 3).otherwise((m >= 3) & (m / n >= 0.20))


def progression(n_tags_without_c2: Column, n: Column, high: Column) -> Column:
    """Whether stages progress or enough alerts are severe (FLT-17)."""
    return (n_tags_without_c2 >= 2) | F.when(n <= 3, high >= 1).otherwise(high / n >= 0.25)
