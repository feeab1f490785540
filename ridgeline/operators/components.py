"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.tables import BROADCAST_ROWS, materialize, release

#: Edges that a task reduces at a time, and the most that it holds.
PART_ROWS = 50_000


#: Nodes with over one in so many edges are joined by broadcast; they are fewer.
HOT_SHARE = 1_000


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Joins each edge with the least neighbour of its src; ``least`` (src, least, n) is written, and ``n`` counts the edges of src."""
    if rows <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least.drop("n")), "src")
    busy = F.broadcast(least.filter(F.col("n") * HOT_SHARE > rows).select("src", F.col("least").alias("_least")))
    marked = edges.join(busy, "src", "left")
    rest = marked.filter("_least is null").drop("_least").join(least.filter(F.col("n") * HOT_SHARE <= rows).drop("n"), "src")
    return marked.filter("_least is not null").withColumnRenamed("_least", "least").unionByName(rest)


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """Links the neighbours of every node (large: its larger ones; small: its smaller ones and itself) to the least of all."""
    count = F.count(F.lit(1)).alias("n")
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = materialize(both.groupBy("src").agg(F.min("dst").alias("least"), count).select("src", F.least("src", "least").alias("least"), "n"), "least")
        out = _with_least(both.filter("dst > src"), least, rows)
    else:
        least = materialize(edges.groupBy("src").agg(F.min("dst").alias("least"), count), "least")
        out = _with_least(edges, least, rows).unionByName(least.select("src", F.col("src").alias("dst"), "least"))
    out = materialize(out.filter("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct(), "cc")
    release(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none, which no further round would change."""
    if edges.groupBy("src").count().filter("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").limit(1).count()


def least_nodes(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """(node, least node of its component) for the edges' nodes that aren't least themselves."""
    nodes = pa.chunked_array([*src.chunks, *dst.chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[nodes.indices.to_numpy()]
    a, b = code[: len(src)], code[len(src) :]
    above = np.arange(len(order))
    while True:
        x, y = above[a], above[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while True:  # every node to the top of its chain
            higher = above[above]
            if (higher == above).all():
                break
            above = higher
    below = np.flatnonzero(above != np.arange(len(order)))
    names = nodes.dictionary.take(pa.array(order))
    return names.take(pa.array(below)), names.take(pa.array(above[below]))


def reduce_parts(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The edges (src, dst) that are left of runs of ``rows`` edges: each run's nodes to their least node. No more than a run and a batch are held."""

    def reduced(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(run)
        return pa.RecordBatch.from_arrays(list(least_nodes(table.column("src"), table.column("dst"))), schema=table.schema)

    run, n = [], 0
    for b in batches:
        while b.num_rows:
            run.append(b.slice(0, rows - n))
            n, b = n + run[-1].num_rows, b.slice(rows - n)
            if n == rows:
                yield reduced(run)
                run, n = [], 0
    if run:
        yield reduced(run)


def _in_parts(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (src, dst) of the components that each part of at most ``PART_ROWS`` edges has by itself, to their least node."""
    most = PART_ROWS
    return edges.coalesce(-(-rows // most)).mapInArrow(lambda batches: reduce_parts(batches, most), edges.schema)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node that it is connected to, except for roots themselves.

    Edges are kept as (larger, smaller). Each part of ``PART_ROWS`` edges is first reduced to its own components in one
    task, which is all there is to do for a small table. Beyond that a round is a large and a small star, each written to
    shared storage with its least neighbours, until all edges lead to roots. Counts and minima combine before shuffles and
    are taken once, and nodes with very many edges are joined by broadcast.
    """
    start = edges.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).filter("src != dst").distinct()
    now = materialize(start, "cc")
    count = now.count()
    if count:
        new = materialize(_in_parts(now, count), "cc")
        release(now)
        now = new
    if count <= PART_ROWS:
        return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        n = now.count()
        for large in (True, False):
            new = _star(now, 2 * n, large)
            release(now)
            now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def members(nodes: DataFrame, edges: DataFrame, node: str = "alert_id") -> DataFrame:
    """(cluster, node) for every row of ``nodes``: its component's least node, itself if it has no edge."""
    roots = components(edges).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(roots, node, "left").select(F.coalesce("root", node).alias("cluster"), node)
