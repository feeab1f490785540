"""Isolation forest and agglomerative clusters, the fused baseline of the oracle tier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A tree of random cuts: (column, cut, left, right), or the mean depth that a leaf adds."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth == 0 or not len(spread):
        return (average_path(len(x)),)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    low = x[:, column] < cut
    return column, cut, grow(x[low], rng, depth - 1), grow(x[~low], rng, depth - 1)


def _depths(tree: tuple, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + tree[0]
        return
    low = x[at, tree[0]] < tree[1]
    if low.any():
        _depths(tree[2], x, at[low], depth + 1, out)
    if not low.all():
        _depths(tree[3], x, at[~low], depth + 1, out)


def isolation_scores(rows: DataFrame, names: list[str], train: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``rows`` with ``isolation`` in 0..1, higher for what few cuts isolate.

    Each tree grows on ``sample`` rows drawn by hash from those where ``train`` holds, so fitting takes at most
    ``trees * sample`` rows whatever the table's size; scoring is in place.
    """
    drawn = rows.filter(train).orderBy(F.xxhash64("alert_id", F.lit(seed)), "alert_id").limit(trees * sample).select(*names).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []
    shared, scale = rows.sparkSession.sparkContext.broadcast(forest), max(average_path(size), 1e-9)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        total = np.zeros(len(x))
        for t in shared.value:
            _depths(t, x, np.arange(len(x)), 0, total)
        return pd.Series(2.0 ** -(total / max(len(shared.value), 1) / scale) if shared.value else np.full(len(x), 0.5))

    return rows.withColumn("isolation", score(*[F.col(n) for n in names]))


def merge_labels(x: np.ndarray, limit: float) -> np.ndarray:
    """Cluster of each point: Ward merges, nearest pair first, until the next would exceed ``limit``."""
    n = len(x)
    label, size = np.arange(n), np.ones(n)
    if n < 2:
        return label
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    while True:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] <= limit * limit:
            break
        i, j = min(i, j), max(i, j)
        total = size + size[i] + size[j]
        with np.errstate(invalid="ignore"):
            new = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / total
        d[i], d[:, i] = new, new
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        size[j] = 0
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def agglomerative(rows: DataFrame, names: list[str], group: str, limit: float = 1.5, most: int = 3_000) -> DataFrame:
    """(group, alert_id, cluster): Ward clusters within each group. The distances of a group are quadratic, so one with more than ``most`` rows is an error, not a sample."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > most:
            raise ValueError(f"a group has {len(p)} rows; agglomerative clustering takes {most} at most")
        p = p.sort_values("alert_id")
        return p[[group, "alert_id"]].assign(cluster=merge_labels(p[names].to_numpy(float), limit))

    return rows.select(group, "alert_id", *names).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, alert_id {kind['alert_id']}, cluster long")


def fused_probability(rows: DataFrame, label: str = "label", score: str = "isolation") -> DataFrame:
    """``rows`` with probability and prediction that mix half the true label with the scaled score: an upper bound, not a detector (Q24)."""
    ends = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)
    p = F.least(F.greatest(0.5 * F.col(label) + 0.5 * scaled, F.lit(0.0)), F.lit(1.0))
    out = rows.crossJoin(F.broadcast(ends)).withColumn("probability", p).drop("_lo", "_hi")
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
