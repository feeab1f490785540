"""Stage sequences and attack-graph patterns of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions.scalars import lcs_ratio, stage_rank


def stage_sequence(rows: DataFrame, cluster: str, stage: str, order: list[str]) -> DataFrame:
    """(cluster, sequence): stages in order, repeats in a row collapsed, blanks skipped (WIN-03, 04)."""
    kept = rows.filter(F.trim(F.coalesce(F.col(stage), F.lit(""))) != "")
    w = Window.partitionBy(cluster).orderBy(*order)
    changed = kept.withColumn("_before", F.lag(stage).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(stage)))
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(stage).alias("_stage"))))
    return changed.groupBy(cluster).agg(F.transform(listed, lambda x: x["_stage"]).alias("sequence"))


def tag_rows(alerts: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, alert_id, ts, rank, stage): the alerts' tags in the kill chain's order."""
    return alerts.select(cluster, "alert_id", "ts", F.explode("tags").alias("stage")).withColumn("rank", stage_rank(F.col("stage")))


def attack_edges(tags: DataFrame, entities: DataFrame, sequence: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, left, right): steps between different stages (SCL-25, 26).

    They come from ordered pairs of a cluster's alerts that share an entity or of which one has none, and from neighbours in
    the stage sequence. For each shared entity and pair of stages only the earliest of the left and the latest of the right
    matter, so pairs of stages are compared, not pairs of alerts.
    """
    first = lambda df, key: df.groupBy(cluster, *key, "stage").agg(F.min(F.struct("ts", "alert_id")).alias("lo"), F.max(F.struct("ts", "alert_id")).alias("hi"))

    def ordered(x: DataFrame, y: DataFrame, key: list[str]) -> DataFrame:
        a, b = x.select(cluster, *key, F.col("stage").alias("left"), "lo"), y.select(cluster, *key, F.col("stage").alias("right"), "hi")
        return a.join(b, [cluster, *key]).filter("left != right and lo < hi").select(cluster, "left", "right")

    by_entity = first(tags.join(entities, "alert_id"), ["entity"])
    bare, every = first(tags.join(entities, "alert_id", "left_anti"), []), first(tags, [])
    pairs = ordered(by_entity, by_entity, ["entity"]).unionByName(ordered(bare, every, [])).unionByName(ordered(every, bare, []))
    steps = F.zip_with("sequence", F.slice("sequence", 2, F.greatest(F.size("sequence"), F.lit(1))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    walked = sequence.select(cluster, F.explode(steps).alias("s")).select(cluster, "s.*").filter("right is not null and left != right")
    return pairs.unionByName(walked).distinct()


def pattern_scores(stages: Column, edges: Column, sequence: Column) -> list[Column]:
    """A struct (score, n_edges, n_stages, order, pattern) for each known attack graph (SCL-23)."""
    out = []
    for i, (name, (expected, steps)) in enumerate(K.ATTACK_GRAPHS.items()):
        n_stages = F.size(F.array_intersect(stages, F.array(*map(F.lit, expected))))
        n_edges = F.size(F.array_intersect(edges, F.array(*[F.lit(f"{a}->{b}") for a, b in steps])))
        score = n_stages / len(expected) * 0.35 + n_edges / len(steps) * 0.45 + lcs_ratio(sequence, expected) * 0.20
        score = F.round(F.least(F.when(n_edges == 0, score * 0.65).otherwise(score), F.lit(1.0)), 6)
        out.append(F.struct(score.alias("score"), n_edges.alias("n_edges"), n_stages.alias("n_stages"), F.lit(-i).alias("order"), F.when(score > 0, name).otherwise("none").alias("pattern")))
    return out


def best_pattern(clusters: DataFrame) -> DataFrame:
    """``clusters`` (stages, edges, sequence) with ``pattern`` and ``graph_score``: the best by score, edges and stages, then the first (SCL-24)."""
    best = F.array_max(F.array(*pattern_scores(F.col("stages"), F.col("edges"), F.col("sequence"))))
    return clusters.withColumn("_best", best).withColumn("pattern", F.when(F.col("_best.score") > 0, F.col("_best.pattern")).otherwise("none")).withColumn("graph_score", F.col("_best.score")).drop("_best")
