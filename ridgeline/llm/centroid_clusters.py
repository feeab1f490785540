"""Lloyd's clustering in whole numbers, with block norms that spare exact distances."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare
from ridgeline.llm.vectors import matrix, whole_numbers
from ridgeline.operators.tables import materialize

#: Consecutive components whose norm is one number of the compressed vector.
SEGMENT = 8


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The compressed rows of ``x``: norms of their segments (the last may be shorter)."""
    return np.sqrt(np.add.reduceat((x * x).astype(np.float64), np.arange(0, x.shape[1], segment), axis=1))


def lower_bounds(xx: np.ndarray, x_norms: np.ndarray, cc: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """Whole numbers that no squared distance of a row to a centroid is below.

    By Cauchy-Schwarz an inner product is at most the sum over segments of the products of norms; the margin covers the
    rounding of the norms and of their sum.
    """
    most = np.ceil((x_norms @ c_norms.T) * (1 + 1e-12)).astype(np.int64)
    return xx[:, None] + cc[None, :] - 2 * most


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's centroid (of equals the smaller number) and exact squared distance; and how many exact distances that took.

    The centroid of the least bound is measured first; from then on a centroid is measured for the rows only whose bound
    for it is not above the best distance so far.
    """
    xx, cc = (x * x).sum(1), (c * c).sum(1)
    bounds = lower_bounds(xx, norms, cc, segment_norms(c))
    cluster = bounds.argmin(1)
    best = ((x - c[cluster]) ** 2).sum(1)
    first, measured = cluster.copy(), len(x)
    for j in range(len(c)):
        rows = np.flatnonzero((bounds[:, j] <= best) & (first != j))
        if len(rows):
            d = ((x[rows] - c[j]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], j
            measured += len(rows)
    return cluster, best, measured


def compressed(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(vec_id, q, norms): the kept vectors with their segment norms, written to shared storage once for all rounds."""
    kept = whole_numbers(vectors, vec_col, [F.col(id_col).cast("long").alias("vec_id")]).filter(F.size("q") == dims)

    def norms(batches):
        for b in batches:
            n = segment_norms(matrix(b.column("q"), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(n.ravel()), n.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "q", "norms"])

    return materialize(kept.mapInArrow(norms, "vec_id long, q array<int>, norms array<double>"), "compressed")


def first_centroids(table: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose hash comes first; of rows with one id the lesser vector."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = table.select(key.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in got], np.int64)


def assign(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of a compressed table; nothing shuffles."""
    shared, dims = table.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def place(batches):
        for b in batches:
            cluster, distance, _ = nearest(matrix(b.column("q"), dims), matrix_of_norms(b), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(place, "vec_id long, cluster int, distance long")


def matrix_of_norms(b: pa.RecordBatch) -> np.ndarray:
    return b.column("norms").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def totals(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, int, np.ndarray]]:
    """Cluster -> rows, summed distance, exact distances measured, and sum of the rows' components.

    A task sums its own rows and gives one row a cluster; those meet in a sum by cluster, so what reaches the driver is a
    row a cluster.
    """
    shared, (k, dims) = table.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def add(batches):
        n, far, work, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = matrix(b.column("q"), dims)
            cluster, distance, measured = nearest(x, matrix_of_norms(b), shared.value)
            n += np.bincount(cluster, minlength=k)
            np.add.at(far, cluster, distance)
            np.add.at(total, cluster, x)
            work[0] += measured
        some = np.flatnonzero(n + work)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), dims).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(far[some]), pa.array(work[some]), sums], ["cluster", "n", "far", "work", "s"])

    parts = table.mapInArrow(add, "cluster int, n long, far long, work long, s array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("work").alias("work"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    return {r["cluster"]: (r["n"], r["far"], r["work"], np.array([r[f"s{i}"] for i in range(dims)], np.int64)) for r in rows.collect()}


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``dims`` components, none null or non-finite, are kept as whole numbers (see ``whole_numbers``) with
    their block norms. ``k`` of them start as centroids by the hash of ``salt:id``; each of ``rounds`` rounds assigns all
    vectors (ties to the smaller number) and replaces each centroid that has some by the exact floor of their mean, then
    vectors are assigned once more. Block norms decide only how many exact distances are measured, never a result.

    A round broadcasts the centroids and sums in place: vectors never shuffle, so the size of a cluster doesn't matter. A
    null id is hashed as an empty text and stays null; rows that repeat an id are vectors of their own; with fewer than ``k``
    vectors all of them start; without any the result is empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    table = compressed(vectors, id_col, vec_col, dims)
    c = first_centroids(table, k, salt)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        new = c.copy()
        for j, (n, _, _, s) in totals(table, c).items():
            if n:
                new[j] = s // n  # floors, also below zero
        c = new
    far = {j: t[1] for j, t in totals(table, c).items()}
    names = [sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertias = [int(far.get(j, 0)) for j in range(len(c))]
    return assign(table, c).select("vec_id", "cluster", "distance", pick(inertias).cast("long").alias("cluster_inertia"), F.lit(sum(inertias)).cast("long").alias("inertia"), pick(names).alias("centroid_sha256"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2") -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (SELECT sha256('{salt}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v) ORDER BY h, q LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min((d, cluster)) AS m FROM (SELECT r, cluster, CAST(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS BIGINT) AS d
  FROM v CROSS JOIN c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT m[2] AS cluster, pos, CAST(sum(CAST(q[pos] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{i} USING (r) CROSS JOIN range(1, {dims + 1}) t(pos) GROUP BY ALL),
n{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS q FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN n{i} n ON c.cluster = n.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.cluster = m[2]"""


SQL = _sql()
