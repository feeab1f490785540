"""Places and running sums over whole tables by a two-pass scan: ranges of the order are counted in parallel, then shifted."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.tables import materialize, small_side

#: Bits of a row's place within its partition in ``monotonically_increasing_id``; the partition's number is above them.
PLACE_BITS = 33


def _ranged(rows: DataFrame, keys: Sequence[Column | str], parts: int | None) -> DataFrame:
    """``rows`` in shared storage with ``_at``: range partitions of the keys in order, sorted within, so ``_at`` grows with the order."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")


def _part() -> Column:
    return F.shiftright("_at", PLACE_BITS).cast("int")


def _before(totals: dict[int, float], zero=0) -> Column:
    """What all partitions before a row's own add up to, one literal a partition."""
    last = max(totals, default=0)
    sums = list(accumulate((totals.get(i, zero) for i in range(last)), initial=zero))
    return F.element_at(F.array(*map(F.lit, sums)), _part() + 1)


def number_rows(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "number", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the place of each in ``order``, from 1, among all rows or among those of its ``by``.

    One shuffle by ranges of (by, order); partitions count their own rows, and what comes before them is a literal a
    partition. No task gets more than its range, whatever a group's size; the order must tell rows of a large group apart.
    Equal rows are placed in any order.
    """
    table = _ranged(rows, [*by, *order], parts)
    sizes = {r["p"]: r["n"] for r in table.groupBy(_part().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = table.withColumn(name, F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + _before(sizes).cast("long") + 1).drop("_at")
    if not by:
        return placed
    first = placed.groupBy(*by).agg(F.min(name).alias("_first")).select("_first", *[F.col(b).alias(f"_by_{b}") for b in by])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return placed.join(small_side(materialize(first, "firsts")), same).withColumn(name, F.col(name) - F.col("_first") + 1).select(*rows.columns, name)


def running_sums(rows: DataFrame, order: Sequence[Column | str], sums: dict[str, str], name: str = "number", parts: int | None = None) -> DataFrame:
    """``rows`` with their place ``name`` and running sums, the row included: new column -> column that is summed, in which null is nothing.

    As ``number_rows``; windows lie within a range of the order, and what comes before a range is a literal.
    """
    table = _ranged(rows, order, parts)
    got = table.groupBy(_part().alias("p")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values())]).collect()
    own = Window.partitionBy(_part()).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table.withColumn(name, F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + _before({r["p"]: r["n"] for r in got}).cast("long") + 1)
    for i, (new, c) in enumerate(sums.items()):
        out = out.withColumn(new, F.coalesce(F.sum(c).over(own), F.lit(0)) + _before({r["p"]: r[f"s{i}"] or 0 for r in got}))
    return out.drop("_at")


def shares(rows: DataFrame, order: Sequence[Column | str], k: int, name: str) -> DataFrame:
    """``rows`` with ``name`` 0..k-1 in order: ``k`` runs of equal size, the first ones a row longer where it doesn't divide."""
    placed = number_rows(rows, order, name="_n")
    size, more = divmod(placed.count(), k)
    at, edge = F.col("_n") - 1, more * (size + 1)
    run = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(size, 1)))
    return placed.withColumn(name, run.cast("long")).drop("_n")
