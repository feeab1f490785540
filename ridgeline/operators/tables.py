"""Tables in shared storage and joins that stay safe for keys with very many rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files are deleted when it ends, not when the driver's memory is next collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written inside each ``short_lived`` that is open.
_open: list[list[str]] = []
#: Rows of a key table (tens of bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); local masters without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/ridgeline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to shared storage and reads it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    with dropped_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query that ends leaves no shuffle files; for queries that are run once."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of shared storage."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        for folder in _folders(df):
            delete(df.sparkSession, folder)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is materialized inside when it ends, but for the tables that those given to ``keep`` read, which go to the block around it."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rpartition("/")[2] for f in _folders(df))
        return df

    _open.append([])
    try:
        yield keep
    finally:
        for path in _open.pop():
            if path.rpartition("/")[2] not in kept:
                delete(spark, path)
            elif _open:
                _open[-1].append(path)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows."""
    with dropped_shuffles(df.sparkSession):
        return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small, else as it is."""
    return F.broadcast(df) if few(df, rows) else df


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """Left join with ``right``, which has one row for a key.

    Keys with over 1/``share`` of the ``rows`` of ``left`` are fewer than ``share``, so their rows of ``right`` are
    broadcast; all other keys go through a shuffle in which no key is large. Null keys stay unmatched.
    """
    if few(right):
        return left.join(F.broadcast(right), key, "left")
    hot = F.broadcast(left.groupBy(key).count().filter(F.col("count") * share > rows).select(key, F.lit(True).alias("_hot")))
    marked = left.join(hot, key, "left")
    big = marked.filter("_hot").drop("_hot").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return big.unionByName(marked.filter("_hot is null").drop("_hot").join(right, key, "left"))
