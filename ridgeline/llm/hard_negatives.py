"""Hard negatives by exact search in inverted lists of k-means clusters, with bounds from their radii."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import prepare
from ridgeline.llm.vectors import lloyd, matrix, products, whole_numbers
from ridgeline.operators.tables import materialize, release, small_side

#: Rows that the centroids are fitted on, and the most centroids that there are; every row is in a list.
SAMPLE_ROWS, MOST_LISTS = 16_384, 1_024
#: Rows of a part of a list and queries of a chunk: what meets in one task at a time.
PART_ROWS, CHUNK_ROWS = 4_096, 4_096
#: Lists that a query visits in the first round; the next rounds go up to eight times as many.
FIRST_LISTS = 16
#: Scores that are compared at a time.
SCORES = 1 << 20


@dataclass(frozen=True)
class Lists:
    """Rows (row, id, label, q, cluster, part) by list, and each list's dimension, centroid, squared radius and parts."""

    rows: DataFrame
    dims: np.ndarray
    centroids: list[np.ndarray]
    radius2: np.ndarray
    parts: np.ndarray
    n: int


def build(rows: DataFrame, part_rows: int = PART_ROWS) -> Lists:
    """Deals ``rows`` (row, id, label, q) into the list of the nearest centroid of their dimension; the table is written once.

    Centroids are fitted on the ``SAMPLE_ROWS`` rows whose hash is least, about the square root of all rows, ``MOST_LISTS``
    at most. Rows of a dimension that the sample lacks go to a list around zero. Radii and counts come from all rows. A list
    of more than ``part_rows`` rows is cut into parts by hash, so a crowded cluster is spread over tasks.
    """
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id", "q"), "row").limit(SAMPLE_ROWS).select("q").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.q), []).append(r.q)
    wanted = max(1, min(MOST_LISTS, round(n**0.5)))
    found = {d: lloyd(np.array(x, np.int64).reshape(len(x), d), max(1, wanted * len(x) // len(sample))) for d, x in by_dim.items()}
    first, at = {}, 0
    for d in sorted(found):
        first[d], at = at, at + len(found[d])
    shared = spark.sparkContext.broadcast((found, first))

    def deal(batches):
        known, begin = shared.value
        for b in batches:
            size = b.column("q").value_lengths().to_numpy(zero_copy_only=False)
            cluster, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for d in np.unique(size):
                i = np.flatnonzero(size == d)
                x = matrix(b.column("q").take(pa.array(i)), int(d))
                c = known.get(int(d))
                if c is None:
                    cluster[i], far[i] = -1 - d, (x * x).sum(1)
                    continue
                near = ((c * c).sum(1)[None, :] - 2 * products(x, c)).argmin(1)
                cluster[i], far[i] = begin[int(d)] + near, ((x - c[near]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(far)], [*b.schema.names, "cluster", "far"])

    dealt = materialize(rows.mapInArrow(deal, "row long, id long, label long, q array<int>, cluster long, far long"), "dealt")
    stats = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    dims = sorted({-1 - r["cluster"] for r in stats if r["cluster"] < 0})
    names = {-1 - d: at + i for i, d in enumerate(dims)}
    centroids = [c for d in sorted(found) for c in found[d]] + [np.zeros(d, np.int64) for d in dims]
    radius2, parts = np.full(len(centroids), -1, np.int64), np.zeros(len(centroids), np.int64)
    for r in stats:
        j = names.get(r["cluster"], r["cluster"])
        radius2[j], parts[j] = r["far"], -(-r["n"] // part_rows)
    cluster = F.when(F.col("cluster") < 0, F.lit(at) + F.array_position(F.array(*map(F.lit, dims or [-1])), (-1 - F.col("cluster")).cast("int")) - 1).otherwise(F.col("cluster"))
    many = F.element_at(F.array(*[F.lit(int(p)) for p in parts] or [F.lit(1)]), (cluster + 1).cast("int"))
    lists = dealt.select("row", "id", "label", "q", cluster.cast("int").alias("cluster"), F.pmod(F.xxhash64("row"), many).cast("int").alias("part"))
    return Lists(lists, np.array([len(c) for c in centroids], np.int64), centroids, radius2, parts, n)


def list_bounds(q: np.ndarray, lists: Lists | tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lists of the dimension of ``q``, and what no score in each is below and above.

    A row is its centroid and a rest no longer than the radius, so by Cauchy-Schwarz its score differs from the centroid's by
    |q| times the radius at most. The margin covers the rounding.
    """
    dims, centroids, radius2, parts = lists
    own = np.flatnonzero((dims == len(q)) & (parts > 0))
    c = np.array([centroids[j] for j in own], np.int64).reshape(len(own), len(q))
    middle = products(q[None, :], c)[0].astype(np.float64)
    spread = np.sqrt(float((q * q).sum()) * radius2[own]) * (1 + 1e-12) + np.abs(middle) * 1e-12 + 1
    return own, middle - spread, middle + spread


def plan(q: np.ndarray, low: np.ndarray, high: np.ndarray, lists: tuple, begin: int, end: int) -> np.ndarray:
    """Lists at places ``begin`` to ``end`` in falling order of their upper bound that can hold a score of any window [low, high].

    ``low`` is no less than the k-th best score so far, so visits stop where the bound is strictly below it.
    """
    own, least, most = list_bounds(q, lists)
    order = np.argsort(-most, kind="stable")[begin:end]
    use = ((most[order, None] >= low[None, :]) & (least[order, None] <= high[None, :])).any(1)
    return own[order[use]]


def best_in_part(visits: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """(query, w, score, id, row): of each query's windows the first ``k`` rows of this part, of its label (``same``) or of others."""
    names = ["query", "w", "score", "id", "row"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    out = [[pa.array([], t)] for t in kinds]
    if visits.num_rows and rows.num_rows:
        dims = len(rows.column("q")[0])
        x, label, row = matrix(rows.column("q"), dims), rows.column("label").to_numpy(), rows.column("row").to_numpy()
        ids = rows.column("id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        place = np.empty(len(row), np.int64)  # order of equal scores: by id, nulls last
        place[np.lexsort((row, ids.fill_null(0).to_numpy(zero_copy_only=False), null))] = np.arange(len(row))
        q, own = matrix(visits.column("q"), dims), visits.column("own").to_numpy()
        query, mine = visits.column("query").to_numpy(), visits.column("label").to_numpy()
        windows = [visits.column(c).combine_chunks() for c in ("w", "low", "high")]
        n_windows = windows[0].value_lengths().to_numpy(zero_copy_only=False)
        w, low, high = (a.flatten().to_numpy(zero_copy_only=False) for a in windows)
        of, begin = np.repeat(np.arange(len(q)), n_windows), np.concatenate(([0], np.cumsum(n_windows)))
        step = max(1, SCORES // (len(x) * max(1, int(n_windows.max(initial=1)))))
        for i in range(0, len(q), step):
            j = min(i + step, len(q))
            s = products(q[i:j], x)
            fit = (mine[i:j, None] == label[None, :]) if same else (mine[i:j, None] != label[None, :])
            fit &= own[i:j, None] != row[None, :]
            many = slice(begin[i], begin[j])
            t = of[many] - i
            each = s[t]
            r, c = np.nonzero(fit[t] & (each >= low[many, None]) & (each <= high[many, None]))
            score = each[r, c]
            order = np.lexsort((place[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, score = r[rank < k], c[rank < k], score[rank < k]
            for a, v in zip(out, (pa.array(query[i + t[r]]), pa.array(w[many][r], pa.int32()), pa.array(score), ids.take(pa.array(c)), pa.array(row[c])), strict=True):
                a.append(v)
    return pa.Table.from_arrays([pa.chunked_array(a, t) for a, t in zip(out, kinds, strict=True)], names)


def search(lists: Lists, queries: DataFrame, same: bool, k: int, visited: list | None = None) -> DataFrame:
    """(query, w, rank, score, id, row): for every window of every query the first ``k`` rows by score, then id; exact.

    ``queries`` is (query, own, label, q, w, low, high): arrays of windows, and the row ``own`` that doesn't count. Lists are
    visited in falling order of their upper bound, more of them each round; lists outside all windows are skipped, and a query
    stops where the bound falls strictly below its k-th score. A round ships a query to the parts that it visits, in chunks,
    and each meeting of a part and a chunk is one product in one task; the best so far are written to shared storage.
    ``visited`` gets each round's number of meetings of a query and a part.
    """
    spark = queries.sparkSession
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    shared = spark.sparkContext.broadcast((lists.dims, lists.centroids, lists.radius2, lists.parts))
    shape = "query long, own long, label long, q array<int>, w array<int>, low array<long>, high array<long>, cluster int, part int, chunk int"
    best, begin, end = None, 0, FIRST_LISTS
    order = Window.partitionBy("query", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    while begin < max(len(lists.centroids), 1):

        def visit(batches, begin=begin, end=end):
            for b in batches:
                take, cluster, part = [], [], []
                for i, (q, low, high) in enumerate(zip(b.column("q").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)):
                    for j in plan(np.array(q, np.int64), np.array(low, np.int64), np.array(high, np.int64), shared.value, begin, end):
                        p = int(shared.value[3][j])
                        take += [i] * p
                        cluster += [int(j)] * p
                        part += range(p)
                v = b.select(["query", "own", "label", "q", "w", "low", "high"]).take(pa.array(take, pa.int64()))
                chunk = b.column("chunk").take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*v.columns, pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), chunk], [*v.schema.names, "cluster", "part", "chunk"])

        now = queries.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
        if best is not None:
            full = best.groupBy("query", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
            reached = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
            low = F.transform(F.arrays_zip("w", "low"), lambda x: F.greatest(x["low"], F.coalesce(F.element_at("kth", x["w"]), x["low"])))
            now = now.join(reached, "query", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(low)).drop("kth")
        visits = materialize(now.mapInArrow(visit, shape), "visits")
        met = visits.count()
        if visited is not None:
            visited.append(met)
        if met:
            parts = visits.select("cluster", "part", "chunk").distinct()
            key = ["cluster", "part", "chunk"]
            there = lists.rows.join(small_side(parts), key[:2]).select(*[F.col(c).alias(f"_{c}") for c in key], "row", "id", "label", "q")
            found = visits.groupBy(*key).cogroup(there.groupBy(*[f"_{c}" for c in key])).applyInArrow(lambda a, b: best_in_part(a, b, same, k), "query long, w int, score long, id long, row long")
            every = found if best is None else found.unionByName(best.select("query", "w", "score", "id", "row"))
            new = materialize(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
            if best is not None:
                release(best)
            best = new
        release(visits)
        begin, end = end, end * 8
    return spark.createDataFrame([], "query long, w int, score long, id long, row long, rank int") if best is None else best


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 100, relabel_every: int = 7, labels: int = 10, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", visited: list | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hardest negatives of every anchor and positive.

    Anchors are the rows whose id ``anchor_every`` divides; scores are inner products of whole-number vectors (see
    ``whole_numbers``). An anchor's positives are its first ``positives`` other rows of its label; negatives are the first
    ``negatives`` rows of other labels whose score is ``window`` hundredths of the positive's, bounds included. A label
    becomes (label + 1) % ``labels`` first where ``relabel_every`` divides the id.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Rows with a null id are no anchors
    and come after all others of their score. Rows meet only those of as many components, for which alone the score is
    defined. Rows that repeat an id are rows of their own, each an anchor if the id is one. No anchors, no positives or an
    empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    key, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.when(F.coalesce(key % relabel_every == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
    rows = whole_numbers(vectors.filter(label.isNotNull()), vec_col, [key.alias("id"), moved.alias("label")])
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "q"), "vectors")
    lists = build(rows)
    anchors = rows.filter(F.col("id") % anchor_every == 0).select(F.col("row").alias("query"), F.col("row").alias("own"), "label", "q")
    one = lambda x, t: F.array(F.lit(x).cast(t))
    near = search(lists, anchors.select("*", one(0, "int").alias("w"), one(-(1 << 62), "long").alias("low"), one(1 << 62, "long").alias("high")), True, positives, visited)
    # bounds of the window in whole numbers: up from the lower, down from the upper
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    bands = near.select("query", F.col("rank").alias("w"), down(f"(score * {window[0]} + 99)").alias("low"), down(f"(score * {window[1]})").alias("high")).filter("low <= high")
    by = bands.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("b"))
    wanted = anchors.join(by, "query").select("query", "own", "label", "q", F.col("b.w").alias("w"), F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    hard = search(lists, materialize(wanted, "wanted"), False, negatives, visited)
    pairs = near.select("query", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.join(rows.select(F.col("row").alias("query"), F.col("id").alias("anchor_id")), "query").select("query", "anchor_id")
    out = hard.join(pairs, ["query", "w"]).join(named, "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
