"""Hard negatives and centroid clusters against brute force in plain whole numbers."""

import math
from hashlib import sha256

import numpy as np
import pytest

from ridgeline.llm import centroid_clusters, hard_negatives
from ridgeline.llm.vectors import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, row int, q string, score double"


def frame(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "c", 1, "q", 0.0) for i, v, y in rows], SCHEMA)


def steps(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def random_rows(n, dims, seed, spread=1.0, centres=1, labels=10):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * (6 if centres > 1 else 0)
    x = (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


def odd_rows(dims):
    nan, inf = float("nan"), float("inf")
    return [
        (None, [0.5] * dims, 1), (None, [0.5] * dims, 1), (100, [0.25] * dims, 1), (100, [0.25] * dims, 2), (100, [0.25] * dims, 1), (3, None, 1), (4, [0.1] * (dims - 1) + [None], 1),
        (5, [nan] * dims, 1), (6, [inf] + [0.0] * (dims - 1), 1), (7, [0.125] * dims, None), (8, [0.2] * (dims - 1), 1), (200, [0.2] * (dims - 1), 2), (300, [], 1), (9, [], 1), (400, [0.0] * dims, 3),
        (10, [-0.3] * dims, 2), (11, [0.25] * dims, 1), (12, [0.25] * dims, 2), (12, [0.25] * dims, 2), (500, [-0.3] * dims, 2), (700, [0.25] * dims, 9), (14, [0.21] * dims, 0),
    ]


# --- hard negatives --------------------------------------------------------------------------------------------------
def brute_negatives(rows):
    used = [(i, steps(v), (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and steps(v) is not None]
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, q, y) in enumerate(used):
        if i is None or i % 100:
            continue
        scored = [(sum(p * r for p, r in zip(q, v)), j, z) for b, (j, v, z) in enumerate(used) if b != a and len(v) == len(q)]
        for ps, pid, _ in sorted((s for s in scored if s[2] == y), key=first)[:5]:
            fit = sorted((s for s in scored if s[2] != y and 30 * ps <= 100 * s[0] <= 90 * ps), key=first)[:10]
            out += [(i, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,dims,centres,part,chunk,first", [(400, 6, 1, 4096, 4096, 16), (700, 8, 20, 40, 3, 2), (300, 3, 5, 7, 2, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dims, centres, part, chunk, first):
    monkeypatch.setattr(hard_negatives.build, "__defaults__", (part,))
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "FIRST_LISTS", first)
    rows = random_rows(n, dims, n, 1.0, centres) + odd_rows(dims)
    got = hard_negatives.hard_negatives(frame(spark, rows).repartition(3)).collect()
    want = brute_negatives(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want and len(want) > 100


def test_negatives_of_repeated_vectors_and_a_crowded_label(spark):
    rows = [(i, [0.5, 0.25] if i % 2 else [0.5, 0.125 + i % 5 / 64], 1 if i % 3 else i % 10) for i in range(600)]
    got = hard_negatives.hard_negatives(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(100, [1.0], 1), (1, [1.0], 2)]])
def test_negatives_of_tables_without_pairs(spark, rows):
    got = hard_negatives.hard_negatives(frame(spark, rows))
    assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_far_lists_are_not_visited(spark):
    rows = random_rows(3000, 8, 5, 0.02, 40)
    seen, every = [], []
    got = hard_negatives.hard_negatives(frame(spark, rows), visited=seen)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows)
    anchors, lists = 30, len(np.unique([tuple(v) for v in lloyd(np.array([steps(v) for _, v, _ in rows]), 55)], axis=0))
    every = 2 * anchors * lists
    assert sum(seen) < every / 2


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (500, 16))
    c = lloyd(x, 12)
    near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
    r2 = np.array([((x[near == j] - c[j]) ** 2).sum(1).max(initial=0) for j in range(len(c))])
    lists = (np.full(len(c), 16), list(c), r2, np.bincount(near, minlength=len(c)))
    for q in rng.integers(-400, 400, (20, 16)):
        own, low, high = hard_negatives.list_bounds(q, lists)
        for j, a, b in zip(own, low, high):
            s = x[near == j] @ q
            assert a <= s.min() and s.max() <= b


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    rows = [(i, [4000.5 + i % 17, -3000.25, 60000.0 - i], i % 3) for i in range(201)]
    got = hard_negatives.hard_negatives(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_negatives(rows)
    with pytest.raises(Exception, match="16777216 steps"):
        hard_negatives.hard_negatives(frame(spark, [(100, [70000.0], 1)])).collect()


# --- centroid clusters -----------------------------------------------------------------------------------------------
def brute_clusters(rows, k, rounds, dims):
    kept = [(i, steps(v)) for i, v, _ in rows if v is not None and len(v) == dims and steps(v) is not None]
    order = sorted((sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    c = [q for _, q in order[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        near = [j for _, j in place()]
        for j in set(near):
            own = [q for (_, q), n in zip(kept, near) if n == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)]
    last = place()
    names = [sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, sum(e for e, n in last if n == j), sum(e for e, _ in last), names[j]) for (i, _), (d, j) in zip(kept, last)), key=repr)


@pytest.mark.parametrize("n,dims,k,centres", [(300, 16, 12, 1), (250, 20, 40, 10), (20, 16, 40, 1)])
def test_clusters_equal_brute_force(spark, n, dims, k, centres):
    rows = random_rows(n, dims, n, 0.3, centres) + odd_rows(dims)
    got = centroid_clusters.centroid_clusters(frame(spark, rows).repartition(3), k=k, dims=dims).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, k, 5, dims)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0], 1)], [(1, [float("nan")] * 16, 1)]])
def test_clusters_of_nothing(spark, rows):
    got = centroid_clusters.centroid_clusters(frame(spark, rows), dims=16)
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_vectors_go_to_the_least_number(spark):
    rows = [(i, [0.5] * 16, 1) for i in range(60)]
    got = centroid_clusters.centroid_clusters(frame(spark, rows), dims=16).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_bounds_are_never_above_distances_and_spare_work():
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 1 << 20):
        x, c = rng.integers(-200, 200, (400, 64)) * scale, rng.integers(-200, 200, (9, 64)) * scale
        c[3], c[5] = x[7], x[7]
        bounds = centroid_clusters.lower_bounds((x * x).sum(1), centroid_clusters.segment_norms(x), (c * c).sum(1), centroid_clusters.segment_norms(c))
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (bounds <= d).all()
        cluster, best, _ = centroid_clusters.nearest(x, centroid_clusters.segment_norms(x), c)
        assert (best == d.min(1)).all() and (cluster == d.argmin(1)).all()
    # vectors whose weight lies in different segments: most exact distances are spared
    x = np.zeros((800, 64), np.int64)
    for i in range(800):
        x[i, 8 * (i % 8) : 8 * (i % 8) + 8] = rng.integers(200, 260, 8)
    cluster, best, measured = centroid_clusters.nearest(x, centroid_clusters.segment_norms(x), x[:40])
    d = ((x[:, None, :] - x[None, :40]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (cluster == d.argmin(1)).all() and measured < 800 * 40 / 4
