"""Jaccard join on word shingles with a count-vector R-tree.

A document's set of shingles is hashed into groups; the counts of the groups are a point. Two sets with similarity of t
or more differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) elements, so their points lie within d of each other in sum
of coordinate differences, and the sum of coordinate minima bounds their overlap. The tree has three levels:

1. slabs of size: partners lie in the same slab or the next;
2. cells: a slab cuts the groups into more blocks than d, so partners have equal counts throughout at least one block.
   Points meet in a cell if slab, block and all counts of the block agree. A node of this level is thus a box without
   extent in its block; finding it is a hash lookup, which Spark does by a shuffle. A block without any rare shingle says
   little, since passages that many documents share fill it alike. There are s more blocks than needed, so a set with
   no more than s such blocks leaves their cells out: partners of which one does so agree in another block, too;
3. boxes: cells that share points form candidate groups, small but for true families of near copies. Inside one, points
   of ``GROUPS`` counts or more are packed by halving at the widest coordinate into leaves and inner nodes with upper corners. A
   search goes down from the root and drops nodes, then points, whose summed minima with the searched point are below
   the least overlap that a link of their sizes needs; what survives is verified on the sets.

The counts of level 2 are over as many groups as there are hashes, so that a block of few shingles still tells texts apart
in a corpus of billions; with 64 groups most points would share some block by chance.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACED, by_ids, claim_hashes, hash_words, mix, prepare, slices, text_buffers
from ridgeline.operators.components import components
from ridgeline.operators.tables import dropped_shuffles, few, join_hot, materialize, release, short_lived

#: Least number of groups of the points in boxes, points of a leaf, and nodes of an inner node.
GROUPS, LEAF, FAN = 64, 32, 8
#: Shingles whose cells are shuffled at a time, and the most shares that cells are cut into, each of which reads all texts.
SHARE_SHINGLES, MOST_SHARES = 1 << 24, 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``words`` words link when den * intersection >= num * union."""

    words: int = 5
    num: int = 8
    den: int = 10

    @property
    def distance(self) -> Fraction:
        return Fraction(self.den - self.num, self.den + self.num)

    def overlap(self, both: np.ndarray) -> np.ndarray:
        """The least intersection of two linked sets, given the sum of their sizes."""
        return -(-self.num * both // (self.num + self.den))

    def slabs(self, largest: int) -> np.ndarray:
        """Least sizes of the slabs up to one past ``largest``; a set's partners are in its slab or in the two beside it."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, (out[-1] - 1) * self.den // self.num + 1))
        return np.array([*out, max(out[-1] + 1, (out[-1] - 1) * self.den // self.num + 1)], np.int64)

    def differences(self, slabs: np.ndarray) -> np.ndarray:
        """For each slab the greatest difference of linked sets, the larger of which is in it."""
        d = self.distance
        return np.array([int(2 * (s - 1) * d) for s in slabs[1:].tolist()], np.int64)

    def blocks(self, slabs: np.ndarray) -> np.ndarray:
        """For each slab the number of blocks: more than the greatest difference, by a twelfth and one."""
        d = self.differences(slabs)
        return d + 1 + -(-d // 12)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: runs of ``words`` words, or all words if they are fewer."""
    hashes, _, _, at = hash_words(data, starts, SPACED)
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(words, n)):
            runs[: n - j] += hashes[j:] * power
            power = power * _A
        runs = mix(runs + np.uint64(words))
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= words:
                out.append(np.unique(runs[i : j - words + 1]))
            elif j > i:
                short = np.uint64(j - i)
                for k in range(j - i):
                    short = short + hashes[i + k] * np.uint64(pow(int(_A), k, 1 << 64))
                out.append(mix(np.array([short * _B], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set; distinct sets of a corpus of 10**9 share one with a chance of 3 %, and are then searched as one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        total = mix(np.array([s.sum(dtype=np.uint64) * _A + mix(s ^ _C).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(total.view(np.int64)[0])


def groups_of(size: int) -> int:
    """Groups of a set's point: a power of two, ``GROUPS`` at least, so that a group has some 16 shingles at most and chance alone seldom fills minima."""
    return max(GROUPS, 1 << max(0, -(-int(size) // 16) - 1).bit_length())


def point(s: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((s >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point of more groups as one of fewer."""
    return p.reshape(-1, groups).sum(0, dtype=np.int32)


def cells(sets: list[np.ndarray], rule: Rule, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of every set, as (number of the set, cell): for its own slab, and for the next, where larger partners are.

    ``common`` holds the shingles that don't count as rare, sorted; it decides how many cells there are, never which links
    are found. A cell's key is a hash of slab, block and the sum of the random values of the block's groups, of which
    there are as many as hashes.
    """
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slabs = rule.slabs(int(size.max()))
    blocks, most = rule.blocks(slabs), rule.differences(slabs)
    own = np.searchsorted(slabs, size, "right") - 1
    flat = np.concatenate(sets)
    rare = np.ones(len(flat), bool) if not len(common) else common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
    doc = np.repeat(np.arange(len(sets)), size)
    value = mix(flat ^ _C)
    halves = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    spread = (flat >> np.uint64(32)).astype(np.int64)
    owners, keys = [], []
    with np.errstate(over="ignore"):
        for step in (0, 1):
            slab = own + step
            m = np.where((size > 0) & (most[slab] > 0), blocks[slab], 0)  # no difference: only equal sets can link
            at = np.concatenate(([0], np.cumsum(m)))
            use = m[doc] > 0
            d = doc[use]
            where = at[d] + spread[use] % m[d]
            n = int(at[-1])
            low, high = (np.bincount(where, h[use], n).astype(np.uint64) for h in halves)
            weak = np.bincount(where[rare[use]], minlength=n) == 0
            owner = np.repeat(np.arange(len(sets)), m)
            block = (np.arange(n) - at[owner]).astype(np.uint64)
            key = mix(mix(low * _A + high * _B + block * _C) + slab[owner].astype(np.uint64) * _A)
            # linked sets have m - most equal blocks at least; if either has fewer weak ones, they meet in a strong one
            all_ = np.bincount(owner[weak], minlength=len(sets)) >= m - most[slab]
            keep = ~weak | all_[owner]
            owners.append(owner[keep])
            keys.append(key[keep].view(np.int64))
    return np.concatenate(owners), np.concatenate(keys)


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """Exact verification on the sorted sets."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(big, small)
    common = int((big[np.minimum(at, len(big) - 1)] == small).sum())
    return rule.den * common >= rule.num * (len(a) + len(b) - common)


def pack(points: np.ndarray) -> np.ndarray:
    """An order of points in which runs of ``LEAF`` lie close together: halves at the coordinate of widest spread, again and again."""
    order, work = np.arange(len(points)), [(0, len(points))]
    while work:
        a, b = work.pop()
        if b - a <= LEAF:
            continue
        part = order[a:b]
        axis = int(points[part].var(0).argmax())
        order[a:b] = part[np.argsort(points[part, axis], kind="stable")]
        middle = a + -(-(b - a) // (2 * LEAF)) * LEAF  # leaves stay whole
        work += [(a, middle), (middle, b)]
    return order


class PointTree:
    """A packed R-tree over points in order of size: each node has the upper corner of its points and their least and greatest place."""

    def __init__(self, points: np.ndarray, size: np.ndarray, rule: Rule):
        self.points, self.size, self.rule = points, size, rule
        self.order = pack(points)
        corner, low, high = points[self.order], self.order, self.order
        self.levels = []
        fan = LEAF
        while not self.levels or len(low) > 1:
            at = np.arange(0, len(low), fan)
            corner, low, high = np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((corner, low, high))
            fan = FAN

    def search(self, q: int, first: int) -> np.ndarray:
        """Places from ``first`` to before ``q`` whose sets can link with that of place ``q``, by the summed minima of node and point, then of both points."""
        p, size = self.points[q], self.size
        nodes = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[k]
            nodes = nodes[(low[nodes] < q) & (high[nodes] >= first)]
            bound = np.minimum(corner[nodes], p).sum(1)
            nodes = nodes[bound >= self.rule.overlap(size[np.maximum(low[nodes], first)] + size[q])]
            fan, below = (FAN, len(self.levels[k - 1][1])) if k else (LEAF, len(self.order))
            nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
            nodes = nodes[nodes < below]
        places = np.sort(self.order[nodes])
        places = places[(places >= first) & (places < q)]
        return places[np.minimum(self.points[places], p).sum(1) >= self.rule.overlap(size[places] + size[q])]


def spanning(points: np.ndarray, size: np.ndarray, labels: np.ndarray, fresh: np.ndarray, rule: Rule, check) -> list[tuple[int, int]]:
    """Pairs (by place) that connect what the tree's bound and then ``check`` let through; pairs of equal ``labels`` are known to be
    connected and are not looked at, nor are pairs of which neither is ``fresh``.

    Each set is searched in the tree among those before it in order of size; survivors in another component are checked until none is left.
    """
    order = np.argsort(size, kind="stable")
    size, labels, fresh = size[order], labels[order].copy(), fresh[order]
    tree = PointTree(points[order], size, rule)
    out = []
    for q in range(1, len(size)):
        # smaller sets only, from the first that is large enough
        first = int(np.searchsorted(size, -(-rule.num * size[q] // rule.den)))
        if first >= q or not size[q]:
            continue
        others = tree.search(q, first)
        others = others[(labels[others] != labels[q]) & (fresh[others] | fresh[q])]
        others = others[::-1]  # the nearest in size first
        while len(others):
            o = others[0]
            others = others[1:]
            if check(int(order[o]), int(order[q])):
                out.append((int(order[o]), int(order[q])))
                labels[labels == labels[o]] = labels[q]
                others = others[labels[others] != labels[q]]
    return out


def link_group(sets: list[np.ndarray], labels: np.ndarray, fresh: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning set of links among ``sets``: what ``spanning`` lets through is verified on the sets."""
    size = np.array([len(s) for s in sets], np.int64)
    groups = groups_of(size.max())
    return spanning(np.stack([point(s, groups) for s in sets]), size, labels, fresh, rule, lambda i, j: linked(sets[i], sets[j], rule))


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _each_set(batch: pa.RecordBatch, rule: Rule, size: int = 1 << 20):
    """Runs of a batch's rows with their sets."""
    claim_hashes()
    data, starts = text_buffers(batch.column("text"))
    for i, j in slices(starts, size):
        yield i, j, shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], rule.words)


def set_table(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set): one row per row of ``docs``."""

    def build(batches):
        for b in batches:
            for i, j, sets in _each_set(b, rule):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "set"])

    return _text_rows(docs).mapInArrow(build, "doc_id long, n_shingles long, set long")


def common_shingles(docs: DataFrame, rule: Rule, least: int = 32, most: int = 1_000_000, run: int = 2_000_000) -> np.ndarray:
    """Sorted shingles of many different sets, from all documents: counts of those that repeat within a run of about ``run``
    shingles are summed and kept from ``least`` on, the ``most`` commonest of them (8 MB). Missing one costs time only."""

    def build(batches):
        held, n = {}, 0

        def flush():
            h, c = np.unique(np.concatenate(list(held.values())), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["shingle", "n"])

        for b in batches:
            for _, _, sets in _each_set(b, rule):
                held.update((set_key(s), s) for s in sets if len(s))
                n = sum(map(len, held.values()))
                if n >= run:
                    yield flush()
                    held, n = {}, 0
        if held:
            yield flush()

    counts = _text_rows(docs).mapInArrow(build, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    with dropped_shuffles(docs.sparkSession):
        found = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def cell_rows(docs: DataFrame, rule: Rule, common: np.ndarray, share: int = 0, shares: int = 1) -> DataFrame:
    """(cell, set) of one of ``shares`` shares of all cells. Of sets that meet in a cell within a run of rows only the first goes on; the others get a cell of their own with it,
    so a family of near copies that is a third of all rows sends a few rows a run, not one per copy and cell."""

    shared = docs.sparkSession.sparkContext.broadcast(common)

    def build(batches):
        for batch in batches:
            for _, _, sets in _each_set(batch, rule):
                keys = np.array([set_key(s) for s in sets], np.int64)
                _, once = np.unique(keys, return_index=True)
                owner, cell = cells([sets[i] for i in once], rule, shared.value)
                if shares > 1:
                    mine = mix(cell.view(np.uint64)) % np.uint64(shares) == share
                    owner, cell = owner[mine], cell[mine]
                keys = keys[once]
                order = np.lexsort((owner, cell))
                owner, cell = owner[order], cell[order]
                head = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
                first = owner[np.maximum.accumulate(np.where(head, np.arange(len(cell)), 0))] if len(cell) else owner
                met = np.unique(first[~head] * len(keys) + owner[~head])
                a, b = keys[met // max(len(keys), 1)], keys[met % max(len(keys), 1)]
                with np.errstate(over="ignore"):
                    own = mix(a.view(np.uint64) * _A + mix(b.view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cell[head], own, own))), pa.array(np.concatenate((keys[owner[head]], a, b)))], ["cell", "set"])

    return _text_rows(docs).mapInArrow(build, "cell long, set long")


def meetings(rows: DataFrame) -> DataFrame:
    """(a, b): each set of a cell with the cell's first; rows stream in order of cell, so a cell of any size is a few bytes of state."""

    def pairs(batches):
        cell = first = None
        for b in batches:
            c, s = b.column("cell").to_numpy(), b.column("set").to_numpy()
            if not len(c):
                continue
            head = np.concatenate(([c[0] != cell], c[1:] != c[:-1]))
            lead = np.where(head, np.arange(len(c)), -1)
            lead = np.maximum.accumulate(lead)
            a = np.where(lead >= 0, s[np.maximum(lead, 0)], first if first is not None else 0)
            cell, first = c[-1], a[-1]
            on = np.flatnonzero(a != s)
            if len(on):
                both = np.unique(np.stack([a[on], s[on]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "set").mapInArrow(pairs, "a long, b long").distinct()


def all_meetings(docs: DataFrame, rule: Rule, common: np.ndarray, shares: int) -> DataFrame:
    """(a, b) of all cells, written. Cells are shuffled a share at a time, whose files go before the next: more shares read the texts more often and take less disk."""
    met = [materialize(meetings(cell_rows(docs, rule, common, i, shares)), "met") for i in range(shares)]
    return reduce(DataFrame.unionByName, met)


def wanted_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(set, size, shingles): the shingles of the sets in ``wanted`` (set, doc_id), read again from one document each."""

    def build(batches):
        for b in batches:
            for _, _, sets in _each_set(b, rule):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "size", "shingles"])

    rows = by_ids(_text_rows(docs), wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.mapInArrow(build, "set long, size long, shingles binary")


def links(grouped: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a spanning set of links in every group of ``grouped`` (part, set, label, fresh, shingles); one group is in memory at a time."""

    def run(batches):
        part, rows = None, []
        for b in batches:
            for p, s, label, fresh, raw in zip(*(b.column(c).to_pylist() for c in ("part", "set", "label", "fresh", "shingles")), strict=True):
                if p != part:
                    yield from finish(rows)
                    part, rows = p, []
                if not rows or rows[-1][0] != s:
                    rows.append((s, label, fresh, np.frombuffer(raw, np.uint64)))
        yield from finish(rows)

    def finish(rows):
        if len(rows) > 1:
            found = link_group([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool), rule)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in found], pa.int64()), pa.array([rows[j][0] for _, j in found], pa.int64())], ["a", "b"])

    rows = grouped.repartition("part").sortWithinPartitions("part", "set")
    return rows.select("part", "set", "label", "fresh", "shingles").mapInArrow(run, "a long, b long")


def _at(sets: DataFrame, rule: Rule, common: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(cell, set) and (set, size, point) of ``sets`` (set, size, shingles)."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def each(batches):
        for b in batches:
            yield b.column("set"), [np.frombuffer(r, np.uint64) for r in b.column("shingles").to_pylist()]

    def in_cells(batches):
        for numbers, rows in each(batches):
            owner, cell = cells(rows, rule, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(cell), numbers.take(pa.array(owner))], ["cell", "set"])

    def in_points(batches):
        for numbers, rows in each(batches):
            packed = [point(r, groups_of(len(r))).astype("<u2").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([numbers, pa.array([len(r) for r in rows], pa.int64()), pa.array(packed, pa.binary())], ["set", "size", "point"])

    rows = sets.select("set", "shingles")
    return rows.mapInArrow(in_cells, "cell long, set long"), rows.mapInArrow(in_points, "set long, size long, point binary")


def _near(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): pairs that connect, in every cell of ``rows`` (cell, set, size, point), the sets which the summed minima of their points allow to link."""

    def run(batches):
        cell, held = None, []
        for b in batches:
            for c, s, n, raw in zip(*(b.column(x).to_pylist() for x in ("cell", "set", "size", "point")), strict=True):
                if c != cell:
                    yield from finish(held)
                    cell, held = c, []
                held.append((s, n, np.frombuffer(raw, "<u2").astype(np.int32)))
        yield from finish(held)

    def finish(held):
        if len(held) > 1:
            groups = min(len(p) for _, _, p in held)
            points = np.stack([folded(p, groups) for _, _, p in held])
            found = spanning(points, np.array([n for _, n, _ in held], np.int64), np.arange(len(held)), np.ones(len(held), bool), rule, lambda i, j: True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "set").select("cell", "set", "size", "point").mapInArrow(run, "a long, b long")


def refined(sets: DataFrame, rule: Rule, common: np.ndarray, capacity: int, most_sets: int) -> DataFrame:
    """``sets`` (set, size, shingles, root) with the roots of over ``capacity`` shingles or ``most_sets`` sets divided by the points.

    Passages that many documents share chain cells into roots that hold a large part of a corpus. Their sets are put in
    cells again, this time with their points, and only pairs whose summed minima allow a link hold a root together. Cells
    with the same sets are looked at once. A cell of over ``most_sets`` sets stays together as it is. Sets that
    near no other leave; no pair that can link is parted.
    """
    totals = sets.groupBy("root").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("members"))
    big = materialize(totals.filter((F.col("total") > capacity) | (F.col("members") > most_sets)).select("root"), "big-roots")
    if few(big, 0):
        return sets
    chosen = materialize(by_ids(sets, big, "root", "left_semi").drop("root"), "chosen")
    cell, points = _at(chosen, rule, common)
    cell = materialize(cell, "cells")
    alike = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("sum")).filter("members > 1")
    once = materialize(alike.groupBy("members", "sum").agg(F.min("cell").alias("cell")).select("cell", "members"), "cells-once")
    kept = cell.join(F.broadcast(once) if few(once) else once, "cell")
    near = _near(kept.filter(F.col("members") <= most_sets).join(points, "set"), rule)
    large = materialize(kept.filter(F.col("members") > most_sets).select("cell", "set"), "large-cells")
    if not few(large, 0):
        heads = large.groupBy("cell").agg(F.min("set").alias("a"))
        near = near.unionByName(large.join(heads, "cell").filter("a != set").select("a", F.col("set").alias("b")))
    roots = components(near)
    roots = materialize(roots.select(F.col("node").alias("set"), "root").unionByName(roots.select(F.col("root").alias("set"), "root").distinct()), "near-roots")
    release(cell, once, large)
    parted = chosen.join(F.broadcast(roots) if few(roots) else roots, "set").select("set", "size", "shingles", "root")
    return by_ids(sets, big, "root", "left_anti").select("set", "size", "shingles", "root").unionByName(parted)


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with the component of the links found so far; a set without links is its own."""
    roots = components(found).withColumnRenamed("node", "set").withColumnRenamed("root", "label")
    return sets.join(F.broadcast(roots) if few(roots) else roots, "set", "left").withColumn("label", F.coalesce("label", "set"))


def group_links(sets: DataFrame, rule: Rule, capacity: int, most_sets: int) -> DataFrame:
    """(a, b): a spanning set of links among ``sets`` (set, size, shingles, root), which can link only within a root.

    Roots of up to ``capacity`` shingles and ``most_sets`` sets are compared in one task. A larger one is cut into parts: first the leading part
    meets every part, which connects a family of near copies; then those pairs of parts meet that still hold more than one
    component, parts being cut anew so that large components have parts of their own. No pair of sets is left out.
    """
    # a set weighs its shingles, or what makes most_sets of them a task's share
    sets = sets.withColumn("size", F.greatest("size", F.lit(capacity // most_sets)))
    totals = sets.groupBy("root").agg(F.sum("size").alias("total"))
    big = materialize(totals.filter(F.col("total") > capacity).withColumn("parts", F.ceil(F.col("total") / capacity) + 1), "big")
    small = by_ids(sets, big.select("root"), "root", "left_anti")
    plain = small.select(F.xxhash64("root").alias("part"), "set", F.col("set").alias("label"), F.lit(True).alias("fresh"), "shingles")
    if few(big, 0):
        return materialize(links(plain, rule), "links")
    cut = sets.join(F.broadcast(big) if few(big) else big, "root").withColumn("cut", F.pmod(F.xxhash64("set", F.lit(3)), F.col("parts")))
    every = F.explode(F.when(F.col("cut") == 0, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("cut")))
    lead = cut.select("*", every.alias("with")).select(F.xxhash64("root", "with", F.lit(1)).alias("part"), "set", F.col("set").alias("label"), ((F.col("cut") > 0) | (F.col("with") == 0)).alias("fresh"), "shingles")
    first = materialize(links(plain.unionByName(lead), rule), "links")
    left = materialize(_labelled(cut.select("root", "set", "size", "total"), first).join(sets.select("set", "shingles"), "set"), "left")
    of_label = left.groupBy("root", "label").agg(F.sum("size").alias("own"))
    left = left.join(F.broadcast(of_label) if few(of_label) else of_label, ["root", "label"])
    n_mixed = F.ceil(F.col("total") / capacity) + 1
    own = F.xxhash64("label", F.pmod(F.xxhash64("set", F.lit(5)), F.ceil(F.col("own") / capacity) + 1))
    left = materialize(left.withColumn("cut", F.when(F.col("own") >= capacity, own).otherwise(F.pmod(F.xxhash64("label", F.lit(9)), n_mixed))), "left-cut")
    cuts = materialize(left.groupBy("root", "cut").agg(F.min("label").alias("low"), F.max("label").alias("high")), "cuts")
    x, y = cuts.alias("x"), cuts.alias("y")
    alike = (F.col("x.low") == F.col("x.high")) & (F.col("x.low") == F.col("y.low")) & (F.col("y.low") == F.col("y.high"))
    pairs = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.cut") <= F.col("y.cut"))).filter(~alike)
    pairs = pairs.select(F.col("x.root").alias("root"), F.col("x.cut").alias("i"), F.col("y.cut").alias("j"))
    ends = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cut"))
    met = left.join(F.broadcast(ends) if few(ends) else ends, ["root", "cut"])
    second = links(met.select(F.xxhash64("root", "i", "j", F.lit(2)).alias("part"), "set", "label", F.lit(True).alias("fresh"), "shingles"), rule)
    return first.unionByName(materialize(second, "links"))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), capacity: int = 2_000_000, most_sets: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (size of the set), component_id (least doc_id reachable by links, itself included).

    Words are runs without blanks, A-Z lower-cased; a document's set holds its distinct shingles of ``rule.words`` words, or
    the whole sequence if it has fewer. Equal sets are searched once, however many documents have them. Texts are read
    four times (sets, common shingles, cells, and the shingles of those sets that met others), for cells once a share of them, so no table of all shingles is ever kept.
    ``capacity`` and ``most_sets`` are the shingles and sets that a task compares at a time; they bound memory and drop nothing.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null id have no component. Rows
    that repeat an id belong together only through their sets. Empty tables give no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    table = materialize(set_table(docs, rule), "sets")
    count = table.count()
    reps = table.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    # of all tables between, some of which hold shingles, only the classes stay
    with short_lived(docs.sparkSession) as keep:
        common = common_shingles(docs, rule)
        shingles = table.agg(F.sum("n_shingles")).first()[0] or 0
        met = all_meetings(docs, rule, common, min(MOST_SHARES, 1 + shingles // SHARE_SHINGLES))
        roots = materialize(components(met), "roots")
        release(met)
        active = roots.select(F.col("node").alias("set"), "root").unionByName(roots.select(F.col("root").alias("set"), "root").distinct())
        active = materialize(active.join(reps, "set").filter("rep is not null"), "active")
        sets = wanted_sets(docs, active.select("set", F.col("rep").alias("doc_id")), rule)
        near = active.select("set", "root")
        sets = materialize(sets.join(F.broadcast(near) if few(near) else near, "set"), "active-sets")
        sets = refined(sets, rule, common, capacity, most_sets)
        found = components(group_links(sets, rule, capacity, most_sets))
        # the least doc_id of a component: of its root and of all nodes under it
        pairs = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "set")
        least = materialize(pairs.join(reps, "set").groupBy("root").agg(F.min("rep").alias("least")), "least")
        merged = pairs.join(F.broadcast(least) if few(least) else least, "root").select("set", "least")
        repeated = table.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("set", "rep")
        both = keep(materialize(repeated.join(merged, "set", "full").select("set", F.coalesce("least", "rep").alias("least")), "classes"))
    out = join_hot(table.filter("n_shingles > 0"), both, "set", count)
    some = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return some.unionByName(table.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def sql(words: int = 3, num: int = 90, den: int = 100) -> str:
    """The same for small tables."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {words} + 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE {den} * i >= {num} * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON w.doc_id = m.a
"""
