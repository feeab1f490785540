"""The packed tree of count vectors against all pairs."""

import itertools

import numpy as np
import pytest

from ridgeline.llm import jaccard_join as J


def family_sets(seed, families=30, copies=6, size=120):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(families):
        base = rng.integers(1, 1 << 63, rng.integers(2, size), dtype=np.uint64)
        for _ in range(rng.integers(1, copies + 1)):
            s = base.copy()
            for i in rng.integers(0, len(s), rng.integers(0, max(2, len(s) // 12))):
                s[i] = rng.integers(1, 1 << 63, dtype=np.uint64)
            out.append(np.unique(s))
    return out + [np.zeros(0, np.uint64)]


def closure(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("rule", [J.Rule(3, 90, 100), J.Rule(5, 8, 10)])
@pytest.mark.parametrize("seed", range(4))
def test_search_keeps_every_link_and_follows_the_bound(rule, seed):
    sets = sorted(family_sets(seed), key=len)
    size = np.array([len(s) for s in sets], np.int64)
    points = np.stack([J.point(s, 64) for s in sets])
    tree = J.PointTree(points, size, rule)
    assert len(tree.levels) > 1 and sorted(tree.order.tolist()) == list(range(len(sets)))
    for q in range(1, len(sets)):
        first = int(np.searchsorted(size, -(-rule.num * size[q] // rule.den)))
        want = [o for o in range(first, q) if np.minimum(points[o], points[q]).sum() >= rule.overlap(size[o] + size[q])]
        got = tree.search(q, first).tolist()
        assert got == want and all(o in got for o in range(q) if J.linked(sets[o], sets[q], rule))


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_group_span_its_components(seed):
    rule = J.Rule(5, 8, 10)
    sets = family_sets(seed)
    n = len(sets)
    found = J.link_group(sets, np.arange(n), np.ones(n, bool), rule)
    pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if J.linked(sets[i], sets[j], rule)]
    assert closure(n, found) == closure(n, pairs) and set(map(lambda p: tuple(sorted(p)), found)) <= set(pairs)
    assert J.link_group(sets, np.arange(n), np.zeros(n, bool), rule) == []


def test_large_groups_are_split_by_sets(spark, monkeypatch):
    sets = family_sets(1, families=1, copies=1, size=400)
    base, rng, rows = sets[0], np.random.default_rng(5), []
    for i in range(300):
        s = base.copy()
        s[rng.integers(0, len(s), 3)] = rng.integers(1, 1 << 63, 3, dtype=np.uint64)
        rows.append((i, len(np.unique(s)), bytearray(np.unique(s).tobytes()), 0))
    table = spark.createDataFrame(rows, "set long, size long, shingles binary, root long")
    most, real = [], J.links

    def watched(grouped, rule):
        most.append(grouped.groupBy("part").count().agg({"count": "max"}).first()[0])
        return real(grouped, rule)

    monkeypatch.setattr(J, "links", watched)
    found = [(r.a, r.b) for r in J.group_links(table, J.Rule(5, 8, 10), 2_000_000, 40).collect()]
    assert len(set(closure(300, found))) == 1 and max(x or 0 for x in most) <= 2 * 80


def test_folded_points_are_points_of_fewer_groups():
    s = np.random.default_rng(0).integers(1, 1 << 63, 5000, dtype=np.uint64)
    assert J.groups_of(5000) == 512 and J.groups_of(1) == 64 and J.groups_of(1024) == 64 and J.groups_of(1025) == 128
    assert (J.folded(J.point(s, 512), 64) == J.point(s, 64)).all()


@pytest.mark.parametrize("most_sets", [3, 40])
def test_chains_of_shared_passages_are_parted_and_families_are_not(spark, most_sets):
    rng = np.random.default_rng(3)
    passages = [" ".join(f"p{rng.integers(10**6)}" for _ in range(25)) for _ in range(12)]
    texts = []
    for i in range(90):  # neighbours share a passage, so cells chain them
        own = [" ".join(f"q{rng.integers(10**6)}" for _ in range(int(rng.integers(1, 30)))) for _ in range(2)]
        texts.append(f"{own[0]} {passages[i % 12]} {passages[(i + 1) % 12]} {own[1]}")
    for t in texts[:20]:
        words = t.split()
        for k in range(4):
            words[int(rng.integers(len(words)))] = f"z{k}"
            texts.append(" ".join(words) if k % 2 else t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for rule in (J.Rule(5, 8, 10), J.Rule(3, 90, 100)):
        shingles = [{tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)} for w in map(str.split, texts)]
        pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if rule.den * len(shingles[i] & shingles[j]) >= rule.num * len(shingles[i] | shingles[j])]
        got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, rule, capacity=1500, most_sets=most_sets).collect()}
        assert [got[i] for i in range(len(texts))] == closure(len(texts), pairs)


def test_cells_in_shares_meet_the_same_and_leave_no_shuffle(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    texts = []
    for f in range(12):
        base = list(rng.choice(words, 60))
        for _ in range(4):
            copy = list(base)
            copy[int(rng.integers(60))] = "other"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, J.jaccard_components(docs).collect()))
    seen, plain = [], J.cell_rows

    def watched(docs, rule, common, share=0, shares=1):
        out = plain(docs, rule, common, share, shares)
        seen.append(out.count())
        return out

    monkeypatch.setattr(J, "cell_rows", watched)
    monkeypatch.setattr(J, "SHARE_SHINGLES", 500)
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == want
    # each share holds a part of the cells only, and is shuffled by itself
    assert len(seen) == J.MOST_SHARES == 4 and max(seen) < 0.6 * sum(seen) and min(seen) > 0
    assert len({r[2] for r in want}) < len(want)
