"""Archives of logs: members are read in tasks, checked, and laid out as the folders that the readers expect (SRC-14)."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that a batch holds.
LINES = 10_000


def safe_member(name: str) -> str:
    """The member's path below the destination; one that leads outside of it is an error."""
    path = posixpath.normpath(name)
    if posixpath.isabs(path) or path == ".." or path.startswith("../"):
        raise ValueError(f"unsafe path in an archive: {name}")
    return path


def member_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive, member, number, line) of every regular file in tar archives, compressed or not; an archive is one task, a member is streamed.

    Links and devices are left out. An unsafe member fails the read before a line of its archive is handed on.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer()
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    members = [(m, safe_member(m.name)) for m in t.getmembers() if m.isfile()]
                    for m, name in members:
                        lines: list[str] = []
                        first = 0
                        for line in io.TextIOWrapper(t.extractfile(m), "utf-8", newline="\n"):
                            lines.append(line.removesuffix("\n"))
                            if len(lines) == LINES:
                                yield _batch(archive, name, first, lines)
                                first, lines = first + len(lines), []
                        if lines or not first:
                            yield _batch(archive, name, first, lines)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "archive string, member string, number long, line string")


def _batch(archive: str, member: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "number", "line"])


def extract(spark: SparkSession, path: str | list[str], destination: str) -> list[str]:
    """Writes the members' lines below ``destination``, each as a folder of text at the member's path; returns the paths.

    A member is sorted and written by one task, so that records over several lines stay whole. Members of one path from
    several archives are an error.
    """
    lines = member_lines(spark, path)
    lines.repartition(F.col("member")).sortWithinPartitions("member", "archive", "number").select("member", F.col("line").alias("value")).write.partitionBy("member").text(f"{destination}/_members")
    names = sorted(r["member"] for r in lines.groupBy("member").agg(F.countDistinct("archive").alias("n")).collect() if _only(r))
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{destination}/_members")
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in names:
        to = jvm.org.apache.hadoop.fs.Path(f"{destination}/{name}")
        fs.mkdirs(to.getParent())
        fs.rename(jvm.org.apache.hadoop.fs.Path(top, f"member={escape(name)}"), to)
    fs.delete(top, True)
    return names


def _only(row) -> bool:
    if row["n"] > 1:
        raise ValueError(f"{row['member']} is in {row['n']} archives")
    return True
