"""Evaluation against ground truth: set metrics, incident recall, cluster matches, curves, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.ranking import running_sums
from ridgeline.operators.tables import small_side


def metric_columns(tp: Column, selected: Column, truth: Column) -> list[Column]:
    """Counts and precision, recall, F1, each 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, selected), F.lit(0.0)), F.coalesce(F.try_divide(tp, truth), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [tp.alias("tp"), (selected - tp).alias("fp"), (truth - tp).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def selection_metrics(selected: DataFrame, truth: DataFrame, key: str = "alert_id") -> DataFrame:
    """One row of metrics over two id sets (AGG-13, SET-01, 02): distinct ids of both, one shuffle."""
    both = selected.select(key).distinct().withColumn("s", F.lit(1)).join(truth.select(key).distinct().withColumn("t", F.lit(1)), key, "full")
    c = both.agg(F.count("s").alias("s"), F.count("t").alias("t"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("both"))
    return c.select(*metric_columns(F.col("both"), F.col("s"), F.col("t")))


def incident_recall(truth: DataFrame, selected: DataFrame) -> DataFrame:
    """(incident_id, alerts, hits, recall, any_hit, all_hit) (AGG-15, 17, SET-04, AUX-13)."""
    marked = truth.select("incident_id", "alert_id").distinct().join(selected.select("alert_id").distinct().withColumn("s", F.lit(1)), "alert_id", "left")
    g = marked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("alerts"), F.count("s").alias("hits"))
    return g.select("incident_id", "alerts", "hits", (F.col("hits") / F.col("alerts")).alias("recall"), (F.col("hits") > 0).alias("any_hit"), (F.col("hits") == F.col("alerts")).alias("all_hit"))


def detector_row(name: str, selected: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of a detector with the shares of incidents of which it finds any and all alerts (AGG-14)."""
    r = incident_recall(truth, selected).agg(F.coalesce(F.avg(F.col("any_hit").cast("double")), F.lit(0.0)).alias("incident_recall_any"), F.coalesce(F.avg(F.col("all_hit").cast("double")), F.lit(0.0)).alias("incident_recall_all"))
    # both sides have one row
    return selection_metrics(selected, truth).crossJoin(r).select(F.lit(name).alias("detector"), F.lit("ok").alias("status"), "*")


def not_run(spark, name: str, like: DataFrame) -> DataFrame:
    """The row of a detector that needs a hosted model (EXT-03)."""
    return spark.range(1).select(*[F.lit(name).alias(f.name) if f.name == "detector" else F.lit("not_run").alias(f.name) if f.name == "status" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def best_match(members: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, precision, recall, f1) against the incident of the best F1, zeros without overlap (AGG-18)."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    wanted = truth.groupBy("incident_id").agg(F.count(F.lit(1)).alias("m"))
    hits = members.join(truth, "alert_id").groupBy("cluster", "incident_id").agg(F.count(F.lit(1)).alias("both"))
    pairs = hits.join(sizes, "cluster").join(small_side(wanted), "incident_id")
    p, r = F.col("both") / F.col("n"), F.col("both") / F.col("m")
    best = pairs.withColumn("p", p).withColumn("r", r).withColumn("f", 2 * p * r / (p + r)).groupBy("cluster").agg(F.max(F.struct("f", "p", "r")).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(best, "cluster", "left").select("cluster", zero(F.col("b.p")).alias("precision"), zero(F.col("b.r")).alias("recall"), zero(F.col("b.f")).alias("f1"))


def cluster_summary(rows: DataFrame, entities: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, coherence, span_h, entity_types): share of the commonest tactic, hours covered, kinds of entities (AGG-19..21)."""
    common = rows.groupBy(cluster, "tactic").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    g = common.groupBy(cluster).agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("coherence"), ((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 3.6e9).alias("span_h"))
    kinds = rows.select(cluster, "alert_id").join(entities, "alert_id").groupBy(cluster).agg(F.countDistinct(F.split_part("entity", F.lit(":"), F.lit(1))).alias("entity_types"))
    return g.join(kinds, cluster, "left").withColumn("entity_types", F.coalesce("entity_types", F.lit(0))).withColumn("span_h", F.coalesce("span_h", F.lit(0.0)))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve by ranks, equal scores at their mean rank (AGG-23).

    Scores are counted first; the running sum goes over distinct scores only, in ranges (see ``ranking``).
    """
    by = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running_sums(by, [score], {"upto": "n"}).select("pos", "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(F.try_divide(F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2, (p * n).cast("double")).alias("auc"))


def best_threshold(scored: DataFrame, score: str = "score", label: str = "label", candidates: int = 256) -> DataFrame:
    """One row (threshold, f1): the least of the best thresholds among at most ``candidates`` quantiles (AGG-24).

    Counts by score are cumulated once; every threshold's metrics follow from them.
    """
    by = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running_sums(by, [score], {"upto_pos": "pos", "upto": "n"}, "k")
    total = ranked.agg(F.sum("pos").alias("all"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("d"))
    cum = ranked.crossJoin(F.broadcast(total)).select(score, "k", "all", "d", (F.col("all") - F.col("upto_pos") + F.col("pos")).alias("tp"), (F.col("rows") - F.col("upto") + F.col("n")).alias("sel"))
    step = F.greatest(F.lit(1), F.ceil(F.col("d") / candidates))
    kept = cum.filter((F.col("k") - 1) % step == 0).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("sel") + F.col("all")), F.lit(0.0)))
    return kept.agg(F.max(F.struct("f1", (-F.col(score)).alias("s"))).alias("b")).select((-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def curves(scored: DataFrame, group: str, score: str = "score", label: str = "label", candidates: int = 256) -> DataFrame:
    """(group, auc, threshold, f1): ``roc_auc`` and ``best_threshold`` of each group, from one running sum over all (AGG-23, 24)."""
    by = scored.groupBy(group, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = running_sums(by, [group, score], {"upto_pos": "pos", "upto": "n"}, "k")
    total = ranked.groupBy(group).agg(F.sum("pos").alias("all"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("d"), F.max("upto_pos").alias("_pos"), F.max("upto").alias("_n"), F.max("k").alias("_k"))
    # what groups before add is the last of each running sum less the group's own total
    own = ranked.join(small_side(total), group).withColumn("upto_pos", F.col("upto_pos") - F.col("_pos") + F.col("all")).withColumn("upto", F.col("upto") - F.col("_n") + F.col("rows")).withColumn("k", F.col("k") - F.col("_k") + F.col("d"))
    rank, c = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2, F.col
    tp, selected = c("all") - c("upto_pos") + c("pos"), c("rows") - c("upto") + c("n")
    f1 = F.coalesce(F.try_divide(2.0 * tp, selected + c("all")), F.lit(0.0))
    tried = (c("k") - 1) % F.greatest(F.lit(1), F.ceil(c("d") / candidates)) == 0
    p, n = F.sum("pos"), F.sum(c("n") - c("pos"))
    auc = F.try_divide(F.sum(rank * c("pos")) - p * (p + 1) / 2, (p * n).cast("double"))
    out = own.groupBy(group).agg(auc.alias("auc"), F.max(F.when(tried, F.struct(f1.alias("f1"), (-c(score)).alias("s")))).alias("b"))
    return out.select(group, "auc", (-c("b.s")).alias("threshold"), c("b.f1").alias("f1"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by columns (AGG-11, 28, AUX-15); order them by count down, then key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def top_names(rows: DataFrame, group: str, name: str, k: int = 12) -> DataFrame:
    """(group, name, count, place) of the ``k`` commonest names, equal counts by name (AGG-12)."""
    counts = rows.groupBy(group, name).agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), name))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def with_deltas(variants: DataFrame, baseline: str, columns: list[str], name: str = "variant") -> DataFrame:
    """``variants`` with each metric's difference from the baseline's row (AGG-25)."""
    base = variants.filter(F.col(name) == baseline).select(*[F.col(c).alias(f"_{c}") for c in columns])
    return variants.crossJoin(F.broadcast(base)).select(*variants.columns, *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in columns])


def fold_aggregate(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, population deviation and minimum over folds (AGG-33)."""
    return rows.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, added): rows of a that b lacks and the reverse, repeats counted (SET-08)."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("added")))


def false_positive_clusters(members: DataFrame, truth: DataFrame, k: int = 12) -> DataFrame:
    """Clusters with false positives, most of them first (AGG-31)."""
    marked = members.join(truth.select("alert_id").distinct().withColumn("t", F.lit(1)), "alert_id", "left")
    g = marked.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("t").isNull()).alias("fp"), F.count("t").alias("tp"))
    return g.filter("fp > 0").withColumn("kind", F.when(F.col("tp") == 0, "fp_only").otherwise("mixed")).orderBy(F.desc("fp"), F.desc("size"), "cluster").limit(k)


def missed_incidents(truth: DataFrame, selected: DataFrame, k: int = 12) -> DataFrame:
    """Incidents of which nothing was found, largest first (AUX-14)."""
    missed = incident_recall(truth, selected).filter("hits = 0")
    return missed.select("incident_id", "alerts").orderBy(F.desc("alerts"), "incident_id").limit(k)
